"""Queries on arrays (embeddings as frames), joins, set operations and near-duplicate vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.operators import neighbours as N
from quillon.operators import windowing as W
from quillon.plans.q_metrics import r6
from quillon.plans.registry import query, table

X = "x AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
R = "list_transform({}, lambda v: round(v, 6))"


def unnested(sql, key, *arrays):
    """The SQL's arrays as rows: key, pos and a value of each array."""
    return f"SELECT {key}, unnest(range(len({arrays[0]})))::INT AS pos, {', '.join(f'unnest({a}) AS {a}' for a in arrays)} FROM ({sql})"


def by_place(df, key, *arrays):
    rows = df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z"))
    return rows.select(key, "pos", *[F.col(f"z.{a}").alias(a) for a in arrays])


def frames(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def rounded(c):
    return F.transform(c, lambda v: F.round(v, 6) + 0.0)


@query("frame_levels", f"WITH {X} SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-10::DOUBLE) + 1e-10::DOUBLE), 6) AS rms_db, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak, (list_position(x, list_max(x)) - 1)::INT AS argmax FROM x")
def frame_levels(spark, d):
    return r6(frames(spark, d).select("vec_id", A.rms_db(F.col("x")).alias("rms_db"), A.peak(F.col("x")).alias("peak"), A.argmax(F.col("x")).alias("argmax")))


@query("silence_filter", f"WITH {X} SELECT vec_id FROM x WHERE list_max(list_transform(x, lambda v: abs(v))) >= 0.3 AND len(x) = 64")
def silence_filter(spark, d):
    return frames(spark, d).where((A.peak(F.col("x")) >= 0.3) & (F.size("x") == 64)).select("vec_id")


@query("band_ratio", f"WITH {X}, p AS (SELECT vec_id, list_transform(x, lambda v: v * v) AS p FROM x) SELECT vec_id, round(list_sum(p[2:5]) / list_sum(p[2:]), 6) AS ratio FROM p")
def band_ratio(spark, d):
    return r6(frames(spark, d).select("vec_id", A.band_ratio(F.col("x"), 64 * 2 * 150.0).alias("ratio")))


@query("vector_normalise", unnested(f"WITH {X} SELECT vec_id, list_transform(x, lambda v: round((v - list_min(x)) / (list_max(x) - list_min(x)), 6)) AS minmax, list_transform(x, lambda v: round(greatest(least((v - list_sum(x) / len(x)) / 0.2, 1), -1), 6)) AS centred FROM x", "vec_id", "minmax", "centred"))
def vector_normalise(spark, d):
    return by_place(frames(spark, d).select("vec_id", rounded(A.minmax(F.col("x"))).alias("minmax"), rounded(A.centre_clip(F.col("x"), 0.2)).alias("centred")), "vec_id", "minmax", "centred")


@query("vector_quantise_int8", unnested(f"WITH {X} SELECT vec_id, list_transform(x, lambda v: greatest(least(round_even(v / 0.01::DOUBLE, 0) + 3, 127), -128)::INT) AS q, list_transform(x, lambda v: round((greatest(least(round_even(v / 0.01::DOUBLE, 0) + 3, 127), -128)::INT - 3) * 0.01::DOUBLE, 6)) AS back FROM x", "vec_id", "q", "back"))
def vector_quantise_int8(spark, d):
    q = frames(spark, d).select("vec_id", A.quantise(F.col("x"), 0.01, 3).alias("q"))
    return by_place(q.select("vec_id", "q", rounded(A.dequantise(F.col("q"), 0.01, 3)).alias("back")), "vec_id", "q", "back")


@query("pcm_round_trip", unnested(f"WITH {X} SELECT vec_id, list_transform(x, lambda v: round_even(greatest(least(v, 1), -1) * 32767, 0)::INT) AS pcm FROM x", "vec_id", "pcm"))
def pcm_round_trip(spark, d):
    return by_place(frames(spark, d).select("vec_id", A.to_pcm(F.col("x")).alias("pcm")), "vec_id", "pcm")


@query("shift_roll_mask", unnested(f"WITH {X} SELECT vec_id, {R.format('list_concat([0.0::DOUBLE, 0, 0], x[1:61])')} AS shifted, {R.format('list_concat(x[60:64], x[1:59])')} AS rolled, {R.format('list_concat(x[1:10], list_transform(range(8), lambda i: 0.0::DOUBLE), x[19:])')} AS masked FROM x", "vec_id", "shifted", "rolled", "masked"))
def shift_roll_mask(spark, d):
    x = F.col("x")
    return by_place(frames(spark, d).select("vec_id", rounded(A.shift(x, 3)).alias("shifted"), rounded(A.roll(x, 5)).alias("rolled"), rounded(A.mask(x, F.lit(10), F.lit(8))).alias("masked")), "vec_id", "shifted", "rolled", "masked")


RMS = "sqrt(list_sum(list_transform({0}, lambda v: v * v)) / len({0}))"


@query("mix_at_snr", unnested(f"WITH {X}, n AS (SELECT a.vec_id, a.x AS x, b.x AS n FROM x a JOIN x b ON b.vec_id = a.vec_id + 1) SELECT vec_id, list_transform(range(1, 65), lambda i: round(x[i] + {RMS.format('x')} / (greatest({RMS.format('n')}, 1e-9) * pow(10, 0.5::DOUBLE)) * n[i], 5)) AS mixed FROM n", "vec_id", "mixed"))
def mix_at_snr(spark, d):
    x = frames(spark, d)
    n = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("n"))
    return by_place(x.join(n, "vec_id").select("vec_id", F.transform(A.mix_at_snr(F.col("x"), F.col("n"), 10.0), lambda v: F.round(v, 5) + 0.0).alias("mixed")), "vec_id", "mixed")


@query("gain_and_target_rms", unnested(f"WITH {X} SELECT vec_id, list_transform(x, lambda v: round(greatest(least(v * pow(10, 6 / 20.0::DOUBLE), 1), -1), 6)) AS louder, list_transform(x, lambda v: round(v * 0.1 / greatest({RMS.format('x')}, 1e-9), 6)) AS levelled FROM x", "vec_id", "louder", "levelled"))
def gain_and_target_rms(spark, d):
    return by_place(frames(spark, d).select("vec_id", rounded(A.gain_db(F.col("x"), 6.0)).alias("louder"), rounded(A.scale_to_rms(F.col("x"), 0.1)).alias("levelled")), "vec_id", "louder", "levelled")


@query("pad_and_fit", unnested(f"WITH {X} SELECT vec_id, {R.format('x[17:48]')} AS centre, {R.format('list_concat(x[51:], list_transform(range(18), lambda i: 0.0::DOUBLE))')} AS tail FROM x", "vec_id", "centre", "tail"))
def pad_and_fit(spark, d):
    x = F.col("x")
    return by_place(frames(spark, d).select("vec_id", rounded(A.pad_centre(x, 32)).alias("centre"), rounded(A.fit_window(x, F.lit(50), 32)).alias("tail")), "vec_id", "centre", "tail")


@query("overlapping_frames", f"WITH {X}, f AS (SELECT vec_id, unnest(range(0, 7)) AS frame, x FROM x) SELECT vec_id, frame::INT AS frame, round(list_sum(x[frame * 8 + 1:frame * 8 + 16]), 6) AS total FROM f")
def overlapping_frames(spark, d):
    f = frames(spark, d).select("vec_id", F.posexplode(A.frames(F.col("x"), 16, 8)).alias("frame", "f"))
    return r6(f.select("vec_id", "frame", A.total(F.col("f")).alias("total")))


@query("fixed_stride_offsets", "SELECT doc_id, array_to_string(CASE WHEN n_chars >= 200 THEN range(0, n_chars - 200 + 1, 150)[1:4] ELSE [] END, ',') AS offsets, greatest((n_chars - 200) // 2, 0)::INT AS centre FROM documents")
def fixed_stride_offsets(spark, d):
    n = F.col("n_chars").cast("int")
    return table(spark, d, "documents").select("doc_id", F.array_join(W.mixed_offsets(n, 200, 150, 4).cast("array<string>"), ",").alias("offsets"), F.greatest(F.floor((n - 200) / 2), F.lit(0)).cast("int").alias("centre"))


@query("mel_scale", "SELECT p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel, round(700 * (pow(10, (2595 * log10(1 + p_retailprice / 700)) / 2595) - 1), 4) AS hz FROM part")
def mel_scale(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(A.hz_to_mel(p), 6).alias("mel"), F.round(A.mel_to_hz(A.hz_to_mel(p)), 4).alias("hz"))


BUCKETS = 64
V = f"""w AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {BUCKETS} AS b FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents)), c AS (SELECT doc_id, b, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT doc_id, sum(n) / {BUCKETS}.0::DOUBLE AS mean, sum(n * n) AS q FROM c GROUP BY 1), z AS (SELECT doc_id, mean, sqrt(q - {BUCKETS} * mean * mean) AS len FROM m WHERE q - {BUCKETS} * mean * mean > 1e-9),
d AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.b = y.b AND x.doc_id < y.doc_id GROUP BY ALL),
p AS (SELECT a, b, (dot - {BUCKETS} * za.mean * zb.mean) / (za.len * zb.len) AS cosine FROM d JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE (dot - {BUCKETS} * za.mean * zb.mean) / (za.len * zb.len) >= 0.98)"""


def word_vectors(spark, d):
    """Documents as counts of words hashed to buckets, centred, at length 1."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    c = w.groupBy("doc_id", (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long") % BUCKETS).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = c.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))  # BUCKETS entries at most
    v = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)))
    return m.select("doc_id", N.centred_unit(v).alias("v")).where(F.exists("v", lambda x: x != 0))


@query("near_dup_pairs", f"WITH {V} SELECT a, b, round(cosine, 6) AS cosine FROM p")
def near_dup_pairs(spark, d):
    return r6(N.similar_pairs(word_vectors(spark, d), "doc_id", "v", 0.98, BUCKETS))


CLUSTERS = f"""{V}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(id, root) AS (SELECT doc_id, doc_id FROM z UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
low AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""


@query("near_dup_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT id AS doc_id, root, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM low")
def near_dup_clusters(spark, d):
    return N.similar_clusters(word_vectors(spark, d), "doc_id", "v", 0.98, BUCKETS).select(F.col("id").alias("doc_id"), "root", "cluster")


@query("lookup_join", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey IN (0, 2)")
def lookup_join(spark, d):
    n = table(spark, d, "nation").where(F.col("n_regionkey").isin(0, 2)).select("n_nationkey", "n_name")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("source_union_distinct", "SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def source_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("labelled_union", "SELECT doc_id, 1 AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 0 FROM labels WHERE quality = 0")
def labelled_union(spark, d):
    q = table(spark, d, "labels")
    return q.where("quality = 1").select("doc_id", F.lit(1).alias("label")).unionByName(q.where("quality = 0").select("doc_id", F.lit(0).alias("label")))


@query("required_difference", "SELECT unnest(['click', 'purchase', 'absent']) AS event_type EXCEPT SELECT event_type FROM events")
def required_difference(spark, d):
    want = spark.createDataFrame([("click",), ("purchase",), ("absent",)], "event_type string")
    return want.subtract(table(spark, d, "events").select("event_type"))


@query("parameter_grid", """WITH g AS (SELECT a::DOUBLE AS spacing, b AS distance, c AS snr FROM (SELECT unnest([0.06, 0.1]) AS a), (SELECT unnest([1, 2, 3]) AS b), (SELECT unnest([0, 5, 10]) AS c))
SELECT event_type, spacing, distance::INT AS distance, snr::INT AS snr, count(*) AS n, count(*) FILTER (WHERE value * spacing >= distance * 1.5::DOUBLE + snr * 0.25::DOUBLE) AS heard FROM events, g GROUP BY ALL""")
def parameter_grid(spark, d):
    """Events by kind under each combination of settings: rows are summed up by value first, so that the grid multiplies the sums and not the events."""
    cells = F.flatten(F.transform(F.array(F.lit(0.06), F.lit(0.1)), lambda a: F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda b: F.transform(F.array(F.lit(0), F.lit(5), F.lit(10)), lambda c: F.struct(a.alias("spacing"), b.alias("distance"), c.alias("snr")))))))
    by_value = table(spark, d, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("k"))
    rows = by_value.select("event_type", "value", "k", F.inline(cells))
    heard = F.col("value") * F.col("spacing") >= F.col("distance") * 1.5 + F.col("snr") * 0.25
    return rows.groupBy("event_type", "spacing", "distance", "snr").agg(F.sum("k").alias("n"), F.sum(F.when(heard, F.col("k")).otherwise(0)).alias("heard"))


@query("class_status", "SELECT lang, count(*) AS files, round(sum(n_chars) / 1e6, 3) AS mb FROM documents GROUP BY lang")
def class_status(spark, d):
    from quillon.sources.sinks import class_status

    return class_status(table(spark, d, "documents"), "lang", "n_chars")


@query("source_fingerprint", """WITH l AS (SELECT source, doc_id || ':' || n_chars AS line FROM documents), b AS (SELECT source, substr(md5(line), 1, 3) AS block, sha256(string_agg(line, ',' ORDER BY md5(line), line)) AS h FROM l GROUP BY ALL)
SELECT source, sha256(string_agg(h, ',' ORDER BY block)) AS sha FROM b GROUP BY source""")
def source_fingerprint(spark, d):
    """A digest of each source's file listing (here its ids and lengths): lines are hashed by blocks of their own hashes, then the blocks."""
    line = F.concat_ws(":", "doc_id", "n_chars")
    rows = table(spark, d, "documents").where("doc_id IS NOT NULL AND n_chars IS NOT NULL").select("source", F.struct(F.md5(line.cast("binary")).alias("h"), line.alias("l")).alias("s"))
    blocks = rows.groupBy("source", F.substring("s.h", 1, 3).alias("block")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["l"]), ",").cast("binary"), 256).alias("h"))
    return blocks.groupBy("source").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda s: s["h"]), ",").cast("binary"), 256).alias("sha"))
