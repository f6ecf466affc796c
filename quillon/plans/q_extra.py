"""Queries on augmentation, directions, synthetic nights and detector summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions import augment
from quillon.operators import direction as D
from quillon.operators import episodes as E
from quillon.operators import nights as N
from quillon.plans.q_arrays import X, by_place, frames, rounded, unnested
from quillon.plans.q_metrics import r6
from quillon.plans.q_partition import H
from quillon.plans.q_series import T, ticks
from quillon.plans.registry import query, table
from quillon.sources import tables

U = "(" + H + " / 4294967296.0::DOUBLE)"
SCALED = f"greatest(-1, least(1, v * (0.7::DOUBLE + {U.format(chr(39) + '5|' + chr(39) + ' || vec_id')} * 0.6::DOUBLE)))"


@query("volume_scale", unnested(f"WITH {X} SELECT vec_id, list_transform(x, lambda v: round({SCALED}, 6)) AS scaled FROM x", "vec_id", "scaled"))
def volume_scale(spark, d):
    return by_place(frames(spark, d).select("vec_id", rounded(augment.volume(F.col("x"), 5, F.col("vec_id"))).alias("scaled")), "vec_id", "scaled")


@query("random_offsets", f"SELECT doc_id, floor({U.format(chr(39) + '9|' + chr(39) + ' || doc_id')} * (greatest(n_chars - 200, 0) + 1))::BIGINT AS at FROM documents")
def random_offsets(spark, d):
    return table(spark, d, "documents").select("doc_id", augment.random_offset(F.col("n_chars"), 200, 9, F.col("doc_id")).alias("at"))


@query("equal_width_bands", unnested(f"""WITH {X}, m AS (SELECT vec_id, list_transform(range(8), lambda m: ln(list_sum(list_transform(range(7), lambda k: abs(x[m * 7 + k + 5]))) / 7 + 1e-6)) AS y FROM x),
r AS (SELECT vec_id, y, list_min(y) AS low, CASE WHEN list_max(y) - list_min(y) < 0.01 THEN 1.0::DOUBLE ELSE list_max(y) - list_min(y) END AS span FROM m)
SELECT vec_id, list_transform(y, lambda v: round((v - low) / span, 6)) AS bands FROM r""", "vec_id", "bands"))
def equal_width_bands(spark, d):
    magnitude = F.transform("x", lambda v: F.abs(v))
    return by_place(frames(spark, d).select("vec_id", rounded(augment.equal_width_bands(magnitude, 8, 4, 60)).alias("bands")), "vec_id", "bands")


@query("samples_from_words", "SELECT event_id, (round_even(value * 100000, 0)::INT >> 16)::SMALLINT AS sample FROM events")
def samples_from_words(spark, d):
    word = F.array(F.bround(F.col("value") * 100000, 0).cast("int"))
    return table(spark, d, "events").select("event_id", augment.samples_from_words(word)[0].alias("sample"))


@query("augmentation_chain")
def augmentation_chain(spark, d):
    """Each vector through the chain, with the next one as noise and a bank of two responses."""
    x = frames(spark, d)
    noise = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("noise"))
    label = F.pmod("vec_id", F.lit(2)).cast("int")
    out = augment.chain(F.col("x"), label, 40, F.col("vec_id"), F.col("noise"), [[1.0, 0.5, 0.25], [1.0, 0.0, -0.3]], augment.Chain(shift=6))
    return by_place(x.join(noise, "vec_id", "left").select("vec_id", rounded(out).alias("y")), "vec_id", "y")


@query("relative_paths", "SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END AS path FROM pages")
def relative_paths(spark, d):
    return table(spark, d, "pages").select("page_id", tables.relative_path(F.col("url"), "https:").alias("path"))


@query("version_ban", "SELECT doc_id, regexp_matches(lower(text), 'simulator|demo|mock') AS banned FROM documents WHERE text IS NOT NULL")
def version_ban(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tables.version_banned(F.col("text")).alias("banned"))


TRACK = f"""{T}, f AS (SELECT user_id, tick, value / 100 * 60 - 60 AS level, (event_id % 801) / 100.0::DOUBLE - 4 AS lag, (event_id % 7) / 2.0::DOUBLE AS ratio FROM e),
g AS (SELECT user_id, tick, level, lag, ratio, -50.0::DOUBLE AS floor FROM f WHERE tick = 0 UNION ALL SELECT f.user_id, f.tick, f.level, f.lag, f.ratio,
 CASE WHEN g.level < g.floor + 5 THEN g.floor + 0.02::DOUBLE * (g.level - g.floor) WHEN g.ratio < 1.5 THEN g.floor + 0.002::DOUBLE * (g.level - g.floor) ELSE g.floor END FROM g JOIN f ON f.user_id = g.user_id AND f.tick = g.tick + 1),
v AS (SELECT user_id, greatest(0, least(800, floor((lag + 4) / 0.01::DOUBLE + 0.5)))::BIGINT AS bin, CASE WHEN lag > 0.2::DOUBLE * 4 THEN 'left' WHEN lag < -0.2::DOUBLE * 4 THEN 'right' ELSE 'unknown' END AS side FROM g WHERE level >= floor + 6 AND ratio >= 1.5),
m AS (SELECT user_id, quantile_disc(bin, 0.5) AS bin, count(*) AS frames FROM v GROUP BY 1),
s AS (SELECT user_id, bin * 0.01::DOUBLE - 4 AS lag, frames, CASE WHEN bin * 0.01::DOUBLE - 4 > 0.2::DOUBLE * 4 THEN 'left' WHEN bin * 0.01::DOUBLE - 4 < -0.2::DOUBLE * 4 THEN 'right' ELSE 'unknown' END AS side FROM m)"""


@query("direction_episodes", f"""WITH RECURSIVE {TRACK} SELECT u.user_id, coalesce(s.side, 'unknown') AS side, round(coalesce(s.lag, 0), 6) AS lag, coalesce(s.frames, 0)::BIGINT AS frames,
round(coalesce((SELECT count(*) FROM v WHERE v.user_id = s.user_id AND v.side = s.side) / s.frames, 0), 6) AS confidence FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s ON s.user_id = u.user_id""")
def direction_episodes(spark, d):
    c = D.DirectionParams(floor_start=-50.0)

    def step(s, r):
        D.direction_step(s, r[0], r[1], r[2], c)
        return []

    level, lag, ratio = F.col("value") / 100 * 60 - 60, F.pmod("event_id", F.lit(801)) / 100.0 - 4, F.pmod("event_id", F.lit(7)) / 2.0
    rows = ticks(spark, d).withColumns({"level": level, "lag": lag, "ratio": ratio})
    end = lambda s: [{k: v for k, v in D.direction(s, c).items() if k != "lag_ms"}]
    out = E.fold(rows, "user_id", ["tick"], step, dict, "side string, lag double, confidence double, frames long", ["level", "lag", "ratio"], end)
    return r6(out)


@query("place_episodes", f"""WITH k AS (SELECT c_custkey, unnest(range(5)) AS episode FROM customer), r AS (SELECT c_custkey, episode, 60 + {U.format("'3|' || c_custkey || ':' || episode")} * 120 AS length, 30 + {U.format("'4|' || c_custkey || ':' || episode")} * 30 AS rest FROM k),
s AS (SELECT c_custkey, episode, length, 30 + coalesce(sum(length + rest) OVER (PARTITION BY c_custkey ORDER BY episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s FROM r)
SELECT c_custkey, episode::INT AS episode, round(start_s, 6) AS start_s, round(start_s + length, 6) AS end_s FROM s WHERE start_s + length + 30 <= 600""")
def place_episodes(spark, d):
    return r6(N.place_episodes(table(spark, d, "customer").select("c_custkey"), "c_custkey", 3, 5, 600.0, 30.0, (60.0, 180.0)))


@query("night_events")
def night_events(spark, d):
    placed = N.place_episodes(table(spark, d, "customer").select("c_custkey"), "c_custkey", 3, 5, 600.0, 30.0, (60.0, 180.0))
    return r6(N.night_events(placed, "c_custkey", 6, (3.0, 6.0)))


@query("scores_by_snr", "SELECT (event_id % 5)::BIGINT AS snr, count(*) AS nights, round(avg(CASE WHEN event_type <> 'click' THEN value END), 6) AS latency FROM events GROUP BY 1")
def scores_by_snr(spark, d):
    latency = F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value"))
    return r6(N.by_snr(table(spark, d, "events").select(F.pmod("event_id", F.lit(5)).alias("snr"), latency.alias("latency")), "snr", ["latency"]))


FILES = "f AS (SELECT user_id, count(*) AS frames, count(*) FILTER (WHERE value >= 80) AS hits, count(*) FILTER (WHERE event_type = 'purchase' AND value >= 90) AS n_events FROM events GROUP BY 1)"


def files(spark, d):
    e = table(spark, d, "events")
    return N.file_summary(e.select("user_id", (F.col("value") >= 80).alias("hit")), e.where("event_type = 'purchase' AND value >= 90").select("user_id"), "user_id", "hit")


@query("detector_file_summary", f"WITH {FILES} SELECT user_id, frames, hits, n_events, round(hits / frames, 6) AS ratio FROM f")
def detector_file_summary(spark, d):
    return r6(files(spark, d))


@query("detector_stats", f"WITH {FILES} SELECT user_id, printf('frames=%d events=%d noise_floor=%.1f', frames, n_events, floor(hits / frames * 100 * 10 + 0.5) / 10) AS line FROM f")
def detector_stats(spark, d):
    return files(spark, d).select("user_id", N.stats_line(F.col("frames"), F.col("n_events"), F.col("ratio") * 100).alias("line"))


@query("folder_verdict", f"WITH {FILES}, g AS (SELECT *, user_id % 2 = 0 AS expected FROM f ORDER BY user_id LIMIT 20) SELECT count(*) AS files, count(*) FILTER (WHERE (n_events > 0 OR hits / frames > 0.1) = expected) AS correct, count(*) FILTER (WHERE (n_events > 0 OR hits / frames > 0.1) = expected) / count(*) AS accuracy FROM g")
def folder_verdict(spark, d):
    return N.folder_verdict(files(spark, d).withColumn("expected", F.pmod("user_id", F.lit(2)) == 0), "user_id", "expected")


@query("bench_beds", "SELECT DISTINCT source, lang || '/' || n_chars AS path FROM documents WHERE lang IS NOT NULL")
def bench_beds(spark, d):
    docs = table(spark, d, "documents").select(F.lit("bench").alias("split"), "source", F.lit(0).alias("label"), F.concat_ws("/", "lang", "n_chars").alias("path"))
    return N.beds(docs.where("lang IS NOT NULL"))


@query("platt_fit")
def platt_fit(spark, d):
    """Quality of labelled documents by the logarithm of their length: slope and intercept."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.log(F.col("n_chars") + 1).alias("z")), "doc_id")
    slope, intercept = N.platt_fit(rows, "z", "quality")
    return rows.select("doc_id", F.round("z", 6).alias("z"), F.round(A.sigmoid(slope * F.col("z") + intercept), 4).alias("p"))


_U = [f"({H.format(f"'{90 + k}|' || vec_id")} / 4294967296.0::DOUBLE)" for k in range(5)]


@query("feature_mask", f"""WITH {X}, d AS (SELECT vec_id, x, {_U[0]} AS u, 1 + floor({_U[1]} * 4)::INT AS w, 1 + floor({_U[2]} * 8)::INT AS h, {_U[3]} AS p, {_U[4]} AS q FROM x),
c AS (SELECT *, floor(p * (8 - w + 1))::INT AS a, floor(q * (8 - h + 1))::INT AS b FROM d), k AS (SELECT *, unnest(range(64)) AS k FROM c)
SELECT vec_id, (k // 8)::INT AS frame, (k % 8)::INT AS band, round(CASE WHEN u < 0.5 AND (k % 8 >= a AND k % 8 < a + w OR k // 8 >= b AND k // 8 < b + h) THEN 0 ELSE x[k + 1] END, 6) AS value FROM k""")
def feature_mask(spark, d):
    """Vectors as matrices of eight frames of eight bands, with a stretch of bands and one of frames at 0 in about half of them."""
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("x", i * 8 + 1, F.lit(8)))
    masked = frames(spark, d).select("vec_id", augment.feature_mask(m, 90, F.col("vec_id")).alias("m"))
    return r6(masked.select("vec_id", F.posexplode("m").alias("frame", "row")).select("vec_id", "frame", F.posexplode("row").alias("band", "value")))
