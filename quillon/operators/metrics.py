"""Evaluation metrics of scored rows. 1 is the positive label; a score at the threshold is positive unless strict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranking import global_rank, running_sums

#: Buckets of scores in [0, 1] in falling order, for global ranks.
BUCKETS = 1024


def falling(p: str) -> Column:
    return F.floor((1 - F.col(p)) * BUCKETS)


def guard(a: Column, b: Column) -> Column:
    """a / max(b, 1)"""
    return a / F.greatest(b, F.lit(1))


def confusion(df: DataFrame, y: str, decided: Column, by: list[str] = ()) -> DataFrame:
    yes = F.col(y) == 1
    return df.groupBy(*by).agg(F.count_if(yes & decided).alias("tp"), F.count_if(~yes & decided).alias("fp"), F.count_if(yes & ~decided).alias("fn"), F.count_if(~yes & ~decided).alias("tn"))


def rates(df: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, fpr, fnr and f1 to tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = df.withColumns({"accuracy": guard(tp + tn, tp + tn + fp + fn), "precision": guard(tp, tp + fp), "recall": guard(tp, tp + fn), "fpr": guard(fp, fp + tn), "fnr": guard(fn, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def threshold_sweep(df: DataFrame, y: str, p: str, grid: list[float], strict: bool = False) -> DataFrame:
    """Rates at each threshold of the grid, which a positive reaches (strict: exceeds). Rows are counted once by how many thresholds they reach; the counts of the few
    steps are then summed, so the rows aren't multiplied by the grid."""
    grid = sorted(grid)
    reached = F.size(F.filter(F.lit(grid), lambda t: t < F.col(p) if strict else t <= F.col(p)))
    steps = df.groupBy(reached.alias("k")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    t = df.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(grid)], "i int, threshold double")
    whole = steps.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    got = t.join(F.broadcast(steps), F.col("k") >= F.col("i"), "left").groupBy("i", "threshold").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("fp"))
    got = got.join(F.broadcast(whole)).select("threshold", "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("fp")).alias("tn"))
    return rates(got)


def best_threshold(sweep: DataFrame, most_fnr: float, most_fpr: float) -> DataFrame:
    """The largest threshold that keeps both bounds; else the one with the highest recall (of several the largest)."""
    good = F.max(F.when((F.col("fnr") <= most_fnr) & (F.col("fpr") <= most_fpr), F.col("threshold")))
    return sweep.agg(F.coalesce(good, F.max(F.struct("recall", "threshold"))["threshold"]).alias("threshold"))


def deploy_threshold(sweep: DataFrame, most_fnr: float, most_fpr: float, candidates: list[float], both: list[float], default: float = 0.5) -> DataFrame:
    """The largest candidate that keeps the bound of misses; without one the largest of both that keeps the two bounds; else the default."""
    t, misses = F.col("threshold"), F.col("fnr") <= most_fnr
    first = F.max(F.when(t.isin(candidates) & misses, t))
    second = F.max(F.when(t.isin(both) & misses & (F.col("fpr") <= most_fpr), t))
    return sweep.agg(F.coalesce(first, second, F.lit(float(default))).alias("threshold"))


def distinct_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """(p, pos, neg, tp, fp): rows by distinct score, and running sums from the highest score."""
    by = df.groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    return running_sums(by, falling("p"), [F.col("p").desc()], {"tp": "pos", "fp": "neg"})


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """auc: the share of (positive, negative) pairs in the right order, ties as half."""
    curve = distinct_scores(df, y, p)
    # negatives below a score: all less those at or above it
    whole = curve.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pairs = curve.join(F.broadcast(whole)).agg(F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2)).alias("s"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    return pairs.select((F.col("s") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"), "n_pos", "n_neg")


def recall_at_fpr(df: DataFrame, y: str, p: str, limits: list[float]) -> DataFrame:
    """limit, recall: the highest recall of a threshold whose false positive rate is within the limit (0 if none is)."""
    curve = distinct_scores(df, y, p)
    whole = curve.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    best = curve.join(F.broadcast(whole)).agg(*[F.coalesce(F.max(F.when(F.col("fp") <= F.lit(x) * F.col("n_neg"), F.col("tp") / F.greatest(F.col("n_pos"), F.lit(1)))), F.lit(0.0)).alias(f"r{i}") for i, x in enumerate(limits)])
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("limit"), F.col(f"r{i}").alias("recall")) for i, x in enumerate(limits)])
    return best.select(F.inline(pairs))


class CalibrationError(ValueError):
    """Too few negatives to bound a rate, or no threshold keeps the bound."""


def fpr_threshold(df: DataFrame, y: str, p: str, most_fpr: float) -> DataFrame:
    """above: scores over it keep the false positive rate (the k-th largest negative, k = floor(most_fpr * n) + 1), with the counts it gives."""
    neg = df.where(F.col(y) != 1).select(F.col(p).alias("p"))
    n = neg.agg(F.count(F.lit(1)).alias("n_neg"))
    ranked = global_rank(neg, falling("p"), [F.col("p").desc()])
    above = ranked.join(F.broadcast(n)).where(F.col("rank") == F.floor(F.lit(most_fpr) * F.col("n_neg")) + 1).select(F.col("p").alias("above"), "n_neg")
    hits = df.join(F.broadcast(above)).where(F.col(p) > F.col("above")).agg(F.count_if(F.col(y) != 1).alias("fp"), F.count_if(F.col(y) == 1).alias("tp"))
    return above.join(F.broadcast(hits))


def checked_fpr_threshold(df: DataFrame, y: str, p: str, most_fpr: float, least_negatives: int = 300) -> float:
    got = fpr_threshold(df, y, p, most_fpr).first()
    if got is None or got.n_neg < least_negatives:
        raise CalibrationError(f"{0 if got is None else got.n_neg} negatives; {least_negatives} are needed")
    if not got.tp:
        raise CalibrationError("no positive is above the threshold")
    return got.above


def class_weights(df: DataFrame, y: str, cap: float) -> DataFrame:
    n = df.agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) != 1).alias("n_neg"))
    total = F.col("n_pos") + F.col("n_neg")
    w = lambda c: F.when(F.col(c) > 0, total / (2 * F.col(c))).otherwise(1.0)
    return n.select("n_pos", "n_neg", w("n_pos").alias("w_pos"), w("n_neg").alias("w_neg"), F.least(F.lit(cap), F.col("n_neg") / F.greatest("n_pos", F.lit(1))).alias("pos_weight"))


def stratified_accuracy(df: DataFrame, level: str, correct: Column, bins: int, closed_last: bool = False) -> DataFrame:
    """Accuracy by bins between quantiles of level less its 10th percentile; half-open bins, so the largest value is in none unless closed_last."""
    edges = df.agg(F.percentile(level, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("edges"), F.percentile(level, F.lit(0.1)).alias("floor"))
    rows = df.withColumn("__ok", correct.cast("int")).join(F.broadcast(edges))
    b = F.size(F.filter("edges", lambda e: e <= F.col(level))) - 1
    if closed_last:
        b = F.least(b, F.lit(bins - 1))
    rows = rows.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    low = F.element_at("edges", F.col("bin") + 1) - F.col("floor")
    return rows.withColumn("low", low).groupBy("bin").agg(F.first("low").alias("low"), F.count(F.lit(1)).alias("n"), F.avg("__ok").alias("accuracy"))


def agreement(df: DataFrame, id: str, name: str, p: str, tau: float) -> DataFrame:
    """Of each pair of predictors (names in order) the share of ids that they decide alike, and the largest difference."""
    a, b = (df.select(id, F.col(name).alias(f"name_{x}"), F.col(p).alias(f"p_{x}")) for x in "ab")
    both = a.join(b, id).where("name_a < name_b")
    return both.groupBy("name_a", "name_b").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("p_a") >= tau) == (F.col("p_b") >= tau)).cast("int")).alias("agreement"), F.max(F.abs(F.col("p_a") - F.col("p_b"))).alias("max_diff"))


def parity(df: DataFrame, y: str, p: str, q: str, tau: float, most_auc: float = 0.005, least_agreement: float = 0.99, most_diff: float = 0.05) -> DataFrame:
    """Does q do as p does? auc_diff, agreement, max_diff and passed."""
    a, b = roc_auc(df, y, p).select(F.col("auc").alias("a")), roc_auc(df, y, q).select(F.col("auc").alias("b"))
    got = df.agg(F.avg(((F.col(p) >= tau) == (F.col(q) >= tau)).cast("int")).alias("agreement"), F.max(F.abs(F.col(p) - F.col(q))).alias("max_diff"))
    out = got.join(F.broadcast(a)).join(F.broadcast(b)).withColumn("auc_diff", F.abs(F.col("a") - F.col("b")))
    ok = (F.col("auc_diff") < most_auc) & (F.col("agreement") >= least_agreement) & (F.col("max_diff") <= most_diff)
    return out.select("auc_diff", "agreement", "max_diff", ok.alias("passed"))


def select_model(df: DataFrame, metric: str, tolerance: float, cost: list[str], name: str) -> DataFrame:
    """Of the candidates within tolerance of the best metric the cheapest (then the better, then the first by name)."""
    best = df.agg(F.max(metric).alias("__best"))
    near = df.join(F.broadcast(best)).where(F.col(metric) >= F.col("__best") - tolerance)
    return near.orderBy(*cost, F.col(metric).desc(), name).limit(1).drop("__best")


def clopper_pearson_upper(k: int, n: int, alpha: float = 0.05) -> float:
    """The upper bound of a rate with k of n hits, by bisection on the binomial distribution function."""
    from math import exp, lgamma, log, log1p

    if k >= n:
        return 1.0
    pick = lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    low, high = 0.0, 1.0
    for _ in range(100):
        x = (low + high) / 2
        below = sum(exp(pick(i) + i * log(x) + (n - i) * log1p(-x)) for i in range(k + 1)) if 0 < x < 1 else 1.0
        low, high = (x, high) if below > alpha else (low, x)
    return (low + high) / 2


def summary(df: DataFrame, a: str, b: str) -> DataFrame:
    out = df.agg(F.corr(a, b).alias("corr"), *[f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
    return out


def lower_median(c: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
