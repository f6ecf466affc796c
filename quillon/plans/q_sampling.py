"""Queries on samples and batches of labels; label: 1 where quality is 0 (the rare class)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.hashing import hash32, uniform
from quillon.operators import sampling as S
from quillon.operators.ranking import global_rank
from quillon.plans.q_partition import H
from quillon.plans.registry import query, table


def rare(spark, d):
    return table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))


L = "l AS (SELECT doc_id, 1 - quality AS label FROM labels)"


@query("downsample_1_to_2", f"WITH {L}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H.format(chr(39) + '5|' + chr(39) + ' || doc_id')}, doc_id) AS k FROM l) SELECT doc_id, label FROM r WHERE label = 1 OR k <= 2 * (SELECT count(*) FROM l WHERE label = 1)")
def downsample_1_to_2(spark, d):
    return S.downsample(rare(spark, d), "doc_id", "label", 5)


@query("oversample_copies", f"WITH {L} SELECT doc_id, label, unnest(CASE WHEN label = 1 THEN [0, 1, 2] ELSE [0] END) AS copy FROM l")
def oversample_copies(spark, d):
    return S.oversample(rare(spark, d), "label")


RANKED = f"r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {{h}}, doc_id) AS k FROM l), n AS (SELECT count(*) FILTER (WHERE label = 1) AS p, ceil(count(*) FILTER (WHERE label = 0) / 20)::BIGINT AS b FROM l)".format(h=H.format("'9|' || doc_id"))


@query("balanced_batches", f"WITH {L}, {RANKED} SELECT doc_id, label, ((k - 1) // 20)::BIGINT AS batch FROM r WHERE label = 0 UNION ALL SELECT doc_id, label, (s // 10)::BIGINT FROM (SELECT doc_id, label, unnest(range(k - 1, b * 10, p)) AS s FROM r, n WHERE label = 1)")
def balanced_batches(spark, d):
    return S.balanced_batches(rare(spark, d), "doc_id", "label", 9, 30)


@query("mini_batches", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {H.format(chr(39) + '11|' + chr(39) + ' || doc_id')}, doc_id) AS k FROM labels) SELECT doc_id, ((k - 1) // 64)::BIGINT AS batch FROM r")
def mini_batches(spark, d):
    return S.hash_ranked(table(spark, d, "labels").select("doc_id"), "doc_id", 11).select("doc_id", F.floor((F.col("rank") - 1) / 64).cast("long").alias("batch"))


@query("calibration_subset", f"SELECT doc_id FROM documents ORDER BY {H.format(chr(39) + '13|' + chr(39) + ' || doc_id')}, doc_id LIMIT 200")
def calibration_subset(spark, d):
    return S.hash_top(table(spark, d, "documents").select("doc_id"), "doc_id", 13, 200)


@query("first_n_per_class", "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels) WHERE k <= 20")
def first_n_per_class(spark, d):
    return S.first_per_key(table(spark, d, "labels").select("doc_id", "quality"), "quality", ["doc_id"], 20)


@query("noise_pick", f"WITH b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier), u AS (SELECT event_id, {H.format(chr(39) + '42|0|' + chr(39) + ' || event_id')} AS h FROM events) SELECT event_id, round(h / 4294967296.0::DOUBLE, 6) AS u, s_suppkey FROM u JOIN b ON b.k = u.h % b.n")
def noise_pick(spark, d):
    """A noise for each event, by a hash of (seed, epoch, id) modulo the bank's size."""
    bank = global_rank(table(spark, d, "supplier").select("s_suppkey"), F.floor(F.col("s_suppkey") / 1024), ["s_suppkey"], "k")
    size = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))  # one row
    ev = table(spark, d, "events").select("event_id", hash32(42, 0, F.col("event_id")).alias("h"), F.round(uniform(42, 0, F.col("event_id")), 6).alias("u"))
    picked = ev.join(F.broadcast(size)).withColumn("k", F.pmod("h", F.col("n")) + 1)
    return picked.join(bank, "k").select("event_id", "u", "s_suppkey")
