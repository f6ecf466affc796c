"""Queries on metrics. Scores are fixed functions of a document's length; the label is labels.quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import metrics as M
from quillon.plans.registry import query, table

GRID = [i / 20 for i in range(1, 20)]
S = """s AS (SELECT d.doc_id, l.quality AS y, d.n_chars, ((d.n_chars * 7919) % 1000) / 1000.0::DOUBLE AS p, ((d.n_chars * 7919 + d.n_chars % 7) % 1000) / 1000.0::DOUBLE AS q FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    score = lambda x: F.pmod(x, F.lit(1000)) / F.lit(1000.0)
    n = F.col("n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").select("doc_id", "y", "n_chars", score(n * 7919).alias("p"), score(n * 7919 + n % 7).alias("q"))


def r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


RATES = """(tp + tn) / greatest(tp + tn + fp + fn, 1)::DOUBLE AS accuracy, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall, fp / greatest(fp + tn, 1)::DOUBLE AS fpr, fn / greatest(tp + fn, 1)::DOUBLE AS fnr"""
R6 = "tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1"
C = "count(*) FILTER (WHERE y = 1 AND {d}) AS tp, count(*) FILTER (WHERE y <> 1 AND {d}) AS fp, count(*) FILTER (WHERE y = 1 AND NOT {d}) AS fn, count(*) FILTER (WHERE y <> 1 AND NOT {d}) AS tn"
SWEEP = f"""{S}, c AS (SELECT t AS threshold, {C.format(d="p >= t")} FROM s, (SELECT unnest({GRID}::DOUBLE[]) AS t) GROUP BY t), w AS (SELECT *, {RATES} FROM c)"""


@query("class_weights", "WITH n AS (SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality <> 1) AS n_neg FROM labels) SELECT n_pos, n_neg, round((n_pos + n_neg) / (2 * n_pos)::DOUBLE, 6) AS w_pos, round((n_pos + n_neg) / (2 * n_neg)::DOUBLE, 6) AS w_neg, round(least(2.5::DOUBLE, n_neg / greatest(n_pos, 1)::DOUBLE), 6) AS pos_weight FROM n")
def class_weights(spark, d):
    return r6(M.class_weights(table(spark, d, "labels"), "quality", 2.5))


@query("confusion_metrics", f"WITH {S}, c AS (SELECT {C.format(d='p >= 0.5')} FROM s), w AS (SELECT *, {RATES} FROM c) SELECT {R6} FROM w")
def confusion_metrics(spark, d):
    return r6(M.rates(M.confusion(scored(spark, d), "y", F.col("p") >= 0.5)))


@query("confusion_metrics_strict", f"WITH {S}, c AS (SELECT {C.format(d='p > 0.5')} FROM s), w AS (SELECT *, {RATES} FROM c) SELECT {R6} FROM w")
def confusion_metrics_strict(spark, d):
    return r6(M.rates(M.confusion(scored(spark, d), "y", F.col("p") > 0.5)))


@query("threshold_sweep", f"WITH {SWEEP} SELECT threshold, {R6} FROM w")
def threshold_sweep(spark, d):
    return r6(M.threshold_sweep(scored(spark, d), "y", "p", GRID))


@query("best_threshold", f"WITH {SWEEP} SELECT coalesce(max(threshold) FILTER (WHERE fnr <= 0.5 AND fpr <= 0.6), max_by(threshold, {{'r': recall, 't': threshold}})) AS threshold FROM w")
def best_threshold(spark, d):
    return M.best_threshold(M.threshold_sweep(scored(spark, d), "y", "p", GRID), 0.5, 0.6)


#: The candidates, and the thresholds that may keep both bounds.
CANDIDATES, BOTH = [0.25, 0.3, 0.35, 0.4, 0.45, 0.5], [0.3, 0.35, 0.4, 0.45, 0.5, 0.55]
DEPLOY = f"""WITH {S}, t AS (SELECT unnest({sorted({*CANDIDATES, *BOTH})})::DOUBLE AS threshold),
w AS (SELECT threshold, count(*) FILTER (WHERE y = 1 AND p <= threshold)::DOUBLE / greatest(count(*) FILTER (WHERE y = 1), 1) AS fnr, count(*) FILTER (WHERE y <> 1 AND p > threshold)::DOUBLE / greatest(count(*) FILTER (WHERE y <> 1), 1) AS fpr FROM s, t GROUP BY threshold)
SELECT a.most AS most_fnr, coalesce(max(threshold) FILTER (WHERE threshold IN {tuple(CANDIDATES)} AND fnr <= a.most), max(threshold) FILTER (WHERE threshold IN {tuple(BOTH)} AND fnr <= a.most AND fpr <= 0.8), 0.5::DOUBLE) AS threshold
FROM w, (SELECT unnest([0.15, 0.35, 0.5])::DOUBLE AS most) a GROUP BY a.most"""


@query("deploy_threshold", DEPLOY)
def deploy_threshold(spark, d):
    """The threshold to deploy under three bounds of misses."""
    sweep = M.threshold_sweep(scored(spark, d), "y", "p", sorted({*CANDIDATES, *BOTH}), strict=True)
    rows = [M.deploy_threshold(sweep, most, 0.8, CANDIDATES, BOTH).select(F.lit(most).alias("most_fnr"), "threshold") for most in (0.15, 0.35, 0.5)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("roc_auc", f"WITH {S} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc, count(DISTINCT a.doc_id) AS n_pos, count(DISTINCT b.doc_id) AS n_neg FROM s a, s b WHERE a.y = 1 AND b.y <> 1")
def roc_auc(spark, d):
    return r6(M.roc_auc(scored(spark, d), "y", "p"))


@query("recall_at_fpr", f"WITH {S}, t AS (SELECT a.p, count(*) FILTER (WHERE b.y = 1) AS tp, count(*) FILTER (WHERE b.y <> 1) AS fp FROM (SELECT DISTINCT p FROM s) a, s b WHERE b.p >= a.p GROUP BY a.p), n AS (SELECT count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y <> 1) AS n_neg FROM s), k AS (SELECT unnest([0, 0.01, 0.1, 0.2, 1]::DOUBLE[]) AS x) SELECT x AS \"limit\", round(coalesce(max(tp::DOUBLE / n_pos) FILTER (WHERE fp <= x * n_neg), 0), 6) AS recall FROM k, t, n GROUP BY x")
def recall_at_fpr(spark, d):
    return r6(M.recall_at_fpr(scored(spark, d), "y", "p", [0.0, 0.01, 0.1, 0.2, 1.0]))


@query("fpr_constrained_threshold", f"WITH {S}, r AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS k, count(*) OVER () AS n_neg FROM s WHERE y <> 1), a AS (SELECT p AS above, n_neg FROM r WHERE k = floor(0.1 * n_neg) + 1) SELECT above, n_neg, (SELECT count(*) FROM s, a WHERE p > above AND y <> 1) AS fp, (SELECT count(*) FROM s, a WHERE p > above AND y = 1) AS tp FROM a")
def fpr_constrained_threshold(spark, d):
    return M.fpr_threshold(scored(spark, d), "y", "p", 0.1)


@query("snr_stratified_accuracy", f"WITH {S}, e AS (SELECT quantile_cont(n_chars, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS edges, quantile_cont(n_chars, 0.1) AS floor FROM s), b AS (SELECT *, len(list_filter(edges, lambda x: x <= n_chars)) - 1 AS bin FROM s, e) SELECT bin::INT AS bin, round(any_value(edges[bin + 1] - floor), 6) AS low, count(*) AS n, round(avg((y = (p >= 0.5)::INT)::INT), 6) AS accuracy FROM b WHERE bin BETWEEN 0 AND 4 GROUP BY bin")
def snr_stratified_accuracy(spark, d):
    return r6(M.stratified_accuracy(scored(spark, d), "n_chars", F.col("y") == (F.col("p") >= 0.5).cast("int"), 5))


@query("predictor_agreement", f"WITH {S}, t AS (SELECT doc_id, 'p' AS name, p AS v FROM s UNION ALL SELECT doc_id, 'q', q FROM s UNION ALL SELECT doc_id, 'r', round(1 - p, 3) FROM s) SELECT a.name AS name_a, b.name AS name_b, count(*) AS n, round(avg(((a.v >= 0.65) = (b.v >= 0.65))::INT), 6) AS agreement, round(max(abs(a.v - b.v)), 6) AS max_diff FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY ALL")
def predictor_agreement(spark, d):
    s = scored(spark, d)
    long = s.select("doc_id", F.expr("stack(3, 'p', p, 'q', q, 'r', round(1 - p, 3)) AS (name, v)"))
    return r6(M.agreement(long, "doc_id", "name", "v", 0.65))


AUC = "(SELECT sum(CASE WHEN a.{0} > b.{0} THEN 1.0 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0 END)::DOUBLE / count(*) FROM s a, s b WHERE a.y = 1 AND b.y <> 1)"


@query("int8_parity", f"WITH {S}, m AS (SELECT abs({AUC.format('p')} - {AUC.format('q')}) AS auc_diff, avg(((p >= 0.65) = (q >= 0.65))::INT) AS agreement, max(abs(p - q)) AS max_diff FROM s) SELECT round(auc_diff, 6) AS auc_diff, round(agreement, 6) AS agreement, round(max_diff, 6) AS max_diff, auc_diff < 0.005 AND agreement >= 0.99 AND max_diff <= 0.05 AS passed FROM m")
def int8_parity(spark, d):
    return r6(M.parity(scored(spark, d), "y", "p", "q", 0.65))


@query("model_selection", f"WITH {SWEEP}, b AS (SELECT max(f1) AS best FROM (SELECT {R6}, threshold FROM w)), n AS (SELECT threshold, round(recall, 6) AS recall, tp + fp AS positives FROM w) SELECT threshold, recall, positives FROM n, (SELECT max(recall) AS best FROM n) WHERE recall >= best - 0.2 ORDER BY positives, recall DESC, threshold LIMIT 1")
def model_selection(spark, d):
    sweep = r6(M.threshold_sweep(scored(spark, d), "y", "p", GRID)).select("threshold", "recall", (F.col("tp") + F.col("fp")).alias("positives"))
    return M.select_model(sweep, "recall", 0.2, ["positives"], "threshold")


@query("prediction_summary", f"WITH {S} SELECT round(corr(p, q), 6) AS corr, min(p) AS min_p, max(p) AS max_p, round(avg(p), 6) AS avg_p, min(q) AS min_q, max(q) AS max_q, round(avg(q), 6) AS avg_q FROM s")
def prediction_summary(spark, d):
    return r6(M.summary(scored(spark, d), "p", "q"))


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.6), 6) AS p60, round(quantile_cont(value, 0.9), 6) AS p90, quantile_disc(value, 0.5) AS lower_median, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def percentiles(spark, d):
    return r6(table(spark, d, "events").groupBy("event_type").agg(*[F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in (10, 60, 90)], M.lower_median("value").alias("lower_median"), F.avg("value").alias("mean")))


@query("teacher_soft_target", """WITH t AS (SELECT doc_id, ((n_chars * 31) % 997) / 997.0::DOUBLE AS p FROM documents WHERE n_chars >= 400), j AS (SELECT l.doc_id, l.quality, t.p, coalesce(t.p, l.quality) AS soft FROM labels l LEFT JOIN t ON l.doc_id = t.doc_id), z AS (SELECT *, ln(greatest(least(soft, 1 - 1e-6), 1e-6) / (1 - greatest(least(soft, 1 - 1e-6), 1e-6))) AS z FROM j)
SELECT doc_id, round(soft, 6) AS soft, round(z, 6) AS z, round(1 / (1 + exp(-(1.5::DOUBLE * z - 0.25::DOUBLE))), 6) AS platt FROM z""")
def teacher_soft_target(spark, d):
    from quillon.functions import arrays as A

    docs = table(spark, d, "documents")  # the teacher has no verdict on short texts
    t = docs.where("n_chars >= 400").select("doc_id", (F.col("n_chars") * 31 % 997 / F.lit(997.0)).alias("p"))
    j = table(spark, d, "labels").join(t, "doc_id", "left").select("doc_id", F.coalesce("p", F.col("quality").cast("double")).alias("soft"))
    z = j.withColumn("z", A.logit(F.col("soft")))
    return r6(z.withColumn("platt", A.platt(F.col("z"), 1.5, -0.25)))


FLAG = "CASE WHEN quality = 1 AND p < 0.02 THEN 'weak_positive' WHEN quality = 0 AND p > 0.5 THEN 'snore_in_negative' ELSE '' END"


@query("label_audit_flags", f"WITH s AS (SELECT l.doc_id, l.quality, ((d.n_chars * 7919) % 1000) / 1000.0::DOUBLE AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, quality, p, {FLAG} AS flag FROM s")
def label_audit_flags(spark, d):
    from quillon.functions import arrays as A

    return scored(spark, d).select("doc_id", F.col("y").alias("quality"), "p", A.audit_flag(F.col("y"), F.col("p")).alias("flag"))


@query("exclude_flagged", f"WITH s AS (SELECT l.doc_id, l.quality, ((d.n_chars * 7919) % 1000) / 1000.0::DOUBLE AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id), f AS (SELECT doc_id FROM s WHERE {FLAG} <> '') SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM f)")
def exclude_flagged(spark, d):
    flagged = label_audit_flags(spark, d).where("flag <> ''").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "lang").join(flagged, "doc_id", "left_anti")
