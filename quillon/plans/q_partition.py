"""Queries on splits and duplicates of a manifest. Here documents are the windows: source is the group, lang the
category, the md5 of the text its content; labels come from labels.quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.hashing import hash32
from quillon.operators import partition as P
from quillon.plans.q_arrays import CLUSTERS, near_dup_clusters
from quillon.plans.registry import query, table

H = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, md5, group, category, label, and split by rules."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), "source", F.col("lang").alias("category"))
    labels = table(spark, d, "labels").select("doc_id", "quality")
    fold = F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("int"), F.lit(5))
    split = F.when(F.col("category") == "fr", "test").when(fold == 4, "val").when(fold == 3, "calib").when(F.col("source").startswith("src1") & (F.col("category") == "de"), "bench").otherwise("train")
    return docs.join(labels, "doc_id", "left").select("doc_id", "md5", F.col("source").alias("group"), "category", F.coalesce("quality", F.lit(1)).alias("label"), split.alias("split"))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """The manifest with dup_cluster: the smallest id of the near-duplicate cluster of a document's word vector, or its own id."""
    return manifest(spark, d).join(near_dup_clusters(spark, d).select("doc_id", "root"), "doc_id", "left").withColumn("dup_cluster", F.coalesce("root", "doc_id")).drop("root")


MANIFEST = r"""manifest AS (SELECT d.doc_id, md5(d.text) AS md5, d.source AS "group", d.lang AS category, coalesce(l.quality, 1) AS label,
CASE WHEN d.lang = 'fr' THEN 'test' WHEN regexp_extract(d.source, '(\d+)$', 1)::INT % 5 = 4 THEN 'val' WHEN regexp_extract(d.source, '(\d+)$', 1)::INT % 5 = 3 THEN 'calib'
 WHEN d.source LIKE 'src1%' AND d.lang = 'de' THEN 'bench' ELSE 'train' END AS split
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
PRIO = "CASE split WHEN 'test' THEN 1 WHEN 'train' THEN 2 WHEN 'val' THEN 3 WHEN 'calib' THEN 4 WHEN 'bench' THEN 5 ELSE 6 END"


@query("split_rules", f"WITH {MANIFEST} SELECT split, count(*) AS n FROM manifest GROUP BY split")
def split_rules(spark, d):
    return manifest(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("exact_dedup_keep_one", f"WITH {MANIFEST} SELECT doc_id, md5, split FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY {PRIO}, doc_id) AS k FROM manifest) WHERE k = 1")
def exact_dedup_keep_one(spark, d):
    return P.exact_duplicates(manifest(spark, d), "md5", [P.priority(F.col("split")), "doc_id"]).where("keep_rank = 1").select("doc_id", "md5", "split")


@query("dup_label_conflicts", f"WITH {MANIFEST} SELECT md5, count(*) AS n, count(DISTINCT label) AS n_labels FROM manifest GROUP BY md5 HAVING count(*) > 1")
def dup_label_conflicts(spark, d):
    return manifest(spark, d).groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_labels")).where("n > 1")


@query("exact_dup_provenance", f"WITH {MANIFEST}, k AS (SELECT *, first_value(doc_id) OVER w AS kept_id, first_value(\"group\") OVER w AS kept_source, row_number() OVER w AS k FROM manifest WINDOW w AS (PARTITION BY md5 ORDER BY {PRIO}, doc_id)) SELECT kept_id, kept_source, doc_id AS id, \"group\" AS source, label FROM k WHERE k > 1")
def exact_dup_provenance(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("md5").orderBy(P.priority(F.col("split")), "doc_id")
    out = manifest(spark, d).withColumns({"kept_id": F.first("doc_id").over(w), "kept_source": F.first("group").over(w), "k": F.row_number().over(w)})
    return out.where("k > 1").select("kept_id", "kept_source", F.col("doc_id").alias("id"), F.col("group").alias("source"), "label")


@query("dup_source_pairs", f"WITH {MANIFEST}, k AS (SELECT *, first_value(\"group\") OVER w AS a, row_number() OVER w AS k FROM manifest WINDOW w AS (PARTITION BY md5 ORDER BY {PRIO}, doc_id)) SELECT least(a, \"group\") AS source_a, greatest(a, \"group\") AS source_b, count(*) AS n FROM k WHERE k > 1 GROUP BY ALL")
def dup_source_pairs(spark, d):
    p = exact_dup_provenance(spark, d)
    return p.groupBy(F.least("kept_source", "source").alias("source_a"), F.greatest("kept_source", "source").alias("source_b")).agg(F.count(F.lit(1)).alias("n"))


RESOLVED = f"""RECURSIVE {CLUSTERS}, {MANIFEST}, mc AS (SELECT m.*, coalesce(low.root, m.doc_id) AS dup_cluster FROM manifest m LEFT JOIN low ON low.id = m.doc_id),
ra AS (SELECT *, CASE WHEN min(label) OVER w <> max(label) OVER w THEN 'exact_conflict' END AS r FROM mc WINDOW w AS (PARTITION BY md5)),
rb AS (SELECT * EXCLUDE (r), CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY md5 ORDER BY r IS NOT NULL, {PRIO}, doc_id) > 1 THEN 'exact_dup' ELSE r END AS r FROM ra),
rc AS (SELECT * EXCLUDE (r), CASE WHEN r IS NULL AND min(CASE WHEN r IS NULL THEN label END) OVER w <> max(CASE WHEN r IS NULL THEN label END) OVER w THEN 'cluster_conflict' ELSE r END AS r
 FROM rb WINDOW w AS (PARTITION BY dup_cluster)),
rd AS (SELECT * EXCLUDE (r), CASE WHEN r IS NULL AND {PRIO} > min(CASE WHEN r IS NULL THEN {PRIO} END) OVER (PARTITION BY "group") THEN 'group_split' ELSE r END AS r FROM rc),
resolved AS (SELECT * EXCLUDE (r), CASE WHEN r IS NULL AND {PRIO} > min(CASE WHEN r IS NULL THEN {PRIO} END) OVER (PARTITION BY dup_cluster) THEN 'cluster_split' ELSE r END AS drop_reason FROM rd)"""


def resolved(spark, d):
    return P.resolve(clustered(spark, d), id="doc_id")


@query("partition_isolation", f"WITH {RESOLVED} SELECT doc_id, split, drop_reason FROM resolved")
def partition_isolation(spark, d):
    return resolved(spark, d).select("doc_id", "split", "drop_reason")


@query("drop_counts", f"WITH {RESOLVED} SELECT drop_reason, \"group\", count(*) AS n FROM resolved WHERE drop_reason IS NOT NULL GROUP BY ALL")
def drop_counts(spark, d):
    return resolved(spark, d).where("drop_reason IS NOT NULL").groupBy("drop_reason", "group").agg(F.count(F.lit(1)).alias("n"))


@query("split_invariants", f"""WITH {RESOLVED}, k AS (SELECT * FROM resolved WHERE drop_reason IS NULL)
SELECT 'group_one_split' AS "check", count(*) FILTER (WHERE n > 1) AS violations FROM (SELECT count(DISTINCT split) AS n FROM k GROUP BY "group")
UNION ALL SELECT 'cluster_one_split', count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT split) AS n FROM k GROUP BY dup_cluster)
UNION ALL SELECT 'md5_once', count(*) FILTER (WHERE n > 1) FROM (SELECT count(*) AS n FROM k GROUP BY md5)""")
def split_invariants(spark, d):
    return P.check_invariants(resolved(spark, d).where("drop_reason IS NULL"))


@query("minimum_counts", f"""WITH {RESOLVED}, want(split, label, least) AS (VALUES ('train', 0, 5), ('train', 1, 50), ('test', 0, 5), ('test', 1, 50), ('val', 1, 5))
SELECT w.split, w.label, w.least, count(r.doc_id) AS n, count(r.doc_id) >= w.least AS enough FROM want w LEFT JOIN resolved r ON r.split = w.split AND r.label = w.label AND r.drop_reason IS NULL GROUP BY w.split, w.label, w.least""")
def minimum_counts(spark, d):
    want = spark.createDataFrame([("train", 0, 5), ("train", 1, 50), ("test", 0, 5), ("test", 1, 50), ("val", 1, 5)], "split string, label int, least int")
    have = resolved(spark, d).where("drop_reason IS NULL").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, ["split", "label"], "left").select("split", "label", "least", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("least")).alias("enough"))


@query("split_crosstab", f"""WITH {MANIFEST} SELECT "group" AS source, label, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'calib') AS calib,
count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE split = 'bench') AS bench FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY {PRIO}, doc_id) AS k FROM manifest) WHERE k = 1 GROUP BY ALL""")
def split_crosstab(spark, d):
    kept = P.exact_duplicates(manifest(spark, d), "md5", [P.priority(F.col("split")), "doc_id"]).where("keep_rank = 1")
    names = ["train", "val", "calib", "test", "bench"]
    return kept.groupBy(F.col("group").alias("source"), "label").pivot("split", names).count().na.fill(0, names)


@query("split_by_group_hash", f"""WITH g AS (SELECT DISTINCT md5(text) AS g FROM documents), r AS (SELECT g, row_number() OVER (ORDER BY {H.format("'7|' || g")}, g) AS k, count(*) OVER () AS n FROM g)
SELECT g AS md5, CASE WHEN k <= round_even(0.2 * n, 0)::INT THEN 'bench' WHEN k <= round_even(0.2 * n, 0)::INT + round_even(0.1 * n, 0)::INT THEN 'val' WHEN k <= round_even(0.2 * n, 0)::INT + round_even(0.1 * n, 0)::INT + round_even(0.1 * n, 0)::INT THEN 'calib' ELSE 'train' END AS split FROM r""")
def split_by_group_hash(spark, d):
    docs = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("md5"))
    return P.group_quota_split(docs, "md5", 7, [("bench", 0.2), ("val", 0.1), ("calib", 0.1)], "train")


@query("batch_half_split", f"""SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {H.format("'3|' || doc_id")}, doc_id) <= ceil(0.5 * count(*) OVER (PARTITION BY source)) THEN 'a' ELSE 'b' END AS split FROM documents""")
def batch_half_split(spark, d):
    return P.per_key_split(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 3, 0.5, ("a", "b"))


@query("stratified_split", f"""WITH a AS (SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {H.format("'42|' || doc_id")}, doc_id) <= ceil(0.2 * count(*) OVER (PARTITION BY quality)) THEN 'test' ELSE 'rest' END AS s FROM labels)
SELECT doc_id, quality, CASE WHEN s = 'test' THEN s WHEN row_number() OVER (PARTITION BY quality, s ORDER BY {H.format("'43|' || doc_id")}, doc_id) <= ceil(0.1 * count(*) OVER (PARTITION BY quality, s)) THEN 'val' ELSE 'train' END AS split FROM a""")
def stratified_split(spark, d):
    first = P.per_key_split(table(spark, d, "labels").select("doc_id", "quality"), ["quality"], "doc_id", 42, 0.2, ("test", "rest")).withColumnRenamed("split", "s")
    second = P.per_key_split(first, ["quality", "s"], "doc_id", 43, 0.1, ("val", "train"))
    return second.select("doc_id", "quality", F.when(F.col("s") == "test", "test").otherwise(F.col("split")).alias("split"))


@query("shuffled_80_20", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {H.format("'1|' || doc_id")}, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS split FROM r""")
def shuffled_80_20(spark, d):
    from quillon.operators.ranking import global_rank

    docs = table(spark, d, "documents").select("doc_id").withColumn("h", hash32(1, F.col("doc_id")))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return global_rank(docs, F.shiftright("h", 22), ["h", "doc_id"]).join(F.broadcast(n)).select("doc_id", F.when(F.col("rank") <= F.floor(F.lit(0.8) * F.col("n")), "train").otherwise("val").alias("split"))
