"""Synthetic nights as events, and summaries of detectors over files and nights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.hashing import uniform


def place_episodes(nights: DataFrame, key: str, seed: int, most: int, duration: float, gap: float, length: tuple[float, float]) -> DataFrame:
    """key, episode, start_s, end_s: up to most episodes a night, one after the other with gaps of gap to 2 gap, as far as they fit.

    No fold is needed: a start is the sum of the lengths and gaps before it."""
    k = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("episode")
    draw = lambda s: uniform(seed + s, F.concat_ws(":", F.col(key), F.col("episode")))
    rows = nights.select(F.col(key), k).withColumn("length", F.lit(length[0]) + draw(0) * (length[1] - length[0])).withColumn("rest", F.lit(gap) + draw(1) * gap)
    before = F.aggregate(F.slice("all", 1, F.col("one.episode")), F.lit(0.0), lambda s, x: s + x["length"] + x["rest"])
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("episode", "length", "rest"))).alias("all"))  # most rows at most
    out = whole.select(key, "all", F.explode("all").alias("one")).select(key, F.col("one.episode").alias("episode"), (before + gap).alias("start_s"), F.col("one.length").alias("length"))
    return out.select(key, "episode", "start_s", (F.col("start_s") + F.col("length")).alias("end_s")).where(F.col("end_s") + gap <= duration)


def night_events(episodes: DataFrame, key: str, seed: int, period: tuple[float, float]) -> DataFrame:
    """key, episode, t: pulses within each episode, a period (drawn for the episode) apart."""
    at = F.concat_ws(":", F.col(key), F.col("episode"))
    rows = episodes.withColumn("period", F.lit(period[0]) + uniform(seed, at) * (period[1] - period[0]))
    n = F.floor((F.col("end_s") - 1 - F.col("start_s")) / F.col("period"))
    rows = rows.where(n >= 0).select(key, "episode", "start_s", "period", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("k"))
    return rows.select(key, "episode", (F.col("start_s") + F.col("k") * F.col("period")).alias("t"))


def trace(seed: int, tau: float, cycles: list[tuple[int, int, int]], rest: int) -> list[float]:
    """A test trace of probabilities: cycles (number, hits, misses) with rests between them; no value equals tau."""
    import random

    draw, out = random.Random(seed), []
    for n, hits, misses in cycles:
        for _ in range(n):
            out += [0.85 + 0.1 * draw.random() for _ in range(hits)] + [0.1 * draw.random() for _ in range(misses)]
        out += [0.05] * rest
    out = [round(v, 3) for v in out]
    return [v + 0.001 if abs(v - tau) < 1e-9 else v for v in out]


def by_snr(nights: DataFrame, snr: str, measures: list[str]) -> DataFrame:
    """Nights and the mean of each measure by SNR; NaN counts as missing, and a mean of nothing is null."""
    return nights.groupBy(snr).agg(F.count(F.lit(1)).alias("nights"), *[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in measures])


def file_summary(frames: DataFrame, events: DataFrame, key: str, hit: str) -> DataFrame:
    """By file: frames, hits, ratio and n_events."""
    a = frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col(hit)).alias("hits"))
    b = events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"))
    return a.join(b, key, "left").na.fill(0, ["n_events"]).withColumn("ratio", F.col("hits") / F.greatest("frames", F.lit(1)))


def folder_verdict(summary: DataFrame, key: str, expected: str, first: int = 20) -> DataFrame:
    """Of the first files by name: how many are right, an event or a ratio above a tenth being a detection. expected: boolean column."""
    found = (F.col("n_events") > 0) | (F.col("ratio") > 0.1)
    rows = summary.orderBy(key).limit(first)
    return rows.agg(F.count(F.lit(1)).alias("files"), F.count_if(found == F.col(expected)).alias("correct")).withColumn("accuracy", F.col("correct") / F.greatest("files", F.lit(1)))


def beds(manifest: DataFrame, source: str | None = None, split: str = "bench", label: int = 0) -> DataFrame:
    """(source, path) of the negative windows of a split, of all sources or one, each once, in order."""
    rows = manifest.where((F.col("split") == split) & (F.col("label") == label))
    rows = rows if source is None else rows.where(F.col("source") == source)
    return rows.select("source", "path").distinct().orderBy("source", "path")


def stats_line(frames, events, floor) -> F.Column:
    # halves go up: formats differ in that between engines
    return F.format_string("frames=%d events=%d noise_floor=%.1f", frames, events, F.floor(floor * 10 + 0.5) / 10)


def platt_fit(scores: DataFrame, z: str, y: str, c: float = 1e4) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one score, with a penalty of 1 / (2 c) on the slope."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = scores.select(array_to_vector(F.array(F.col(z).cast("double"))).alias("features"), F.col(y).cast("double").alias("label"))
    n = rows.count()
    model = LogisticRegression(regParam=1 / (c * max(n, 1)), standardization=False, maxIter=1000, tol=1e-10).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)
