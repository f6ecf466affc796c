"""Windows, frames and peaks of ordered series. A series is the rows of a key; tick is a row's place in it, from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticked(df: DataFrame, key: str, order: list, to: str = "tick") -> DataFrame:
    return df.withColumn(to, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def sliding(df: DataFrame, key: str, tick: str, size: int, hop: int, aggs: list[Column]) -> DataFrame:
    """Aggregates of full windows [k * hop, k * hop + size) of each series. Each row goes to the size / hop windows that hold it;
    no series is collected."""
    first = F.greatest(F.ceil((F.col(tick) - size + 1) / hop), F.lit(0)).cast("long")
    rows = df.withColumn("window", F.explode(F.when(first <= F.floor(F.col(tick) / hop), F.sequence(first, F.floor(F.col(tick) / hop).cast("long")))))
    out = rows.groupBy(key, "window").agg(*aggs, F.count(F.lit(1)).alias("__n"))
    return out.where(F.col("__n") == size).drop("__n").withColumn("start", F.col("window") * hop)


def tumbling(df: DataFrame, key: str, tick: str, size: int, aggs: list[Column]) -> DataFrame:
    return sliding(df, key, tick, size, size, aggs)


def ring(df: DataFrame, key: str, tick: str, value: str, n: int) -> DataFrame:
    """From the n-th row on, each row with the mean of the last n."""
    w = Window.partitionBy(key).orderBy(tick).rowsBetween(-(n - 1), 0)
    return df.withColumn("filled", F.count(value).over(w)).withColumn("ring_mean", F.avg(value).over(w)).where(F.col("filled") == n)


def strict_peaks(df: DataFrame, key: str, tick: str, value: str, factor: float) -> DataFrame:
    """Rows larger than the two on each side and than factor times the series' mean."""
    w, v = Window.partitionBy(key).orderBy(tick), F.col(value)
    near = [F.lag(value, k).over(w) for k in (1, 2)] + [F.lead(value, k).over(w) for k in (1, 2)]
    ok = v > F.avg(value).over(Window.partitionBy(key)) * factor
    for x in near:
        ok = ok & (v > x)
    return df.withColumn("__ok", ok).where("__ok").drop("__ok")


def peak_intervals(peaks: DataFrame, key: str, tick: str, low: int, high: int) -> DataFrame:
    """Gaps between neighbouring peaks, and whether they lie within bounds."""
    gap = F.col(tick) - F.lag(tick).over(Window.partitionBy(key).orderBy(tick))
    return peaks.withColumn("gap", gap).where("gap IS NOT NULL").withColumn("periodic", F.col("gap").between(low, high))


def peaks_over(df: DataFrame, key: str, tick: str, value: str, pct: float) -> DataFrame:
    """Rows at or above a percentile of their series, above the row before and not below the one after; the ends count too."""
    w, v = Window.partitionBy(key).orderBy(tick), F.col(value)
    limit = F.percentile(value, F.lit(pct)).over(Window.partitionBy(key))
    ok = (v >= limit) & (v > F.coalesce(F.lag(value).over(w), F.lit(float("-inf")))) & (v >= F.coalesce(F.lead(value).over(w), F.lit(float("-inf"))))
    return df.withColumn("__ok", ok).where("__ok").drop("__ok")


def separated(peaks: DataFrame, key: str, tick: str, value: str, n: int, apart: int) -> DataFrame:
    """Of each series up to n peaks, the highest first, each at least apart from all those taken before."""
    best = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(tick).alias("t"))))
    got = peaks.groupBy(key).agg(best.alias("c"))
    far = lambda acc, x: F.forall(acc, lambda t: F.abs(t - x["t"]) >= apart)
    taken = F.aggregate("c", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) < n) & far(acc, x), F.concat(acc, F.array(x["t"]))).otherwise(acc))
    return got.select(key, F.posexplode(taken).alias("place", tick))


def loudest_window(df: DataFrame, key: str, value: str, window: str) -> DataFrame:
    """The window with the largest value of each series, the first of equal ones."""
    return df.groupBy(key).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(window)).alias("w"))).alias("b")).select(key, (-F.col("b.w")).alias(window), F.col("b.v").alias(value))


def hold_max(df: DataFrame, key: str, tick: str, value: str, hold: int) -> Column:
    return F.max(value).over(Window.partitionBy(key).orderBy(tick).rowsBetween(-hold, 0))


def bursts(df: DataFrame, key: str, tick: str, hit: Column) -> DataFrame:
    """Rows with a hit whose row before has none."""
    rows = df.withColumn("hit", hit)
    return rows.withColumn("__p", F.lag("hit", 1, False).over(Window.partitionBy(key).orderBy(tick))).where("hit AND NOT __p").drop("__p", "hit")


def burst_gaps(starts: DataFrame, key: str, tick: str, within: int) -> DataFrame:
    """For each burst the number of bursts of the last `within` ticks and the lower median of their gaps."""
    w = Window.partitionBy(key).orderBy(tick).rangeBetween(-within, 0)
    rows = starts.withColumn("ticks", F.sort_array(F.collect_list(tick).over(w)))
    gaps = F.array_sort(F.zip_with(F.slice("ticks", 2, F.greatest(F.size("ticks") - 1, F.lit(0))), F.slice("ticks", 1, F.greatest(F.size("ticks") - 1, F.lit(0))), lambda a, b: a - b))
    return rows.withColumn("n_bursts", F.size("ticks")).withColumn("median_gap", F.get(gaps, F.floor((F.size(gaps) - 1) / 2).cast("int"))).drop("ticks")


def overlaps(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans that run into the next one of their key."""
    nxt = F.lead(start).over(Window.partitionBy(key).orderBy(start, end))
    return spans.withColumn("next_start", nxt).where(F.col("next_start") < F.col(end))


def slice_spans(spans: DataFrame, start: str, end: str, hop: float = 1.0, size: float = 1.0, eps: float = 1e-9) -> DataFrame:
    """Each span's windows of a size that lie within it."""
    n = F.floor((F.col(end) - F.col(start) - size + eps) / hop)
    return spans.where(n >= 0).withColumn("k", F.explode(F.sequence(F.lit(0), n.cast("int")))).withColumn("offset_s", F.col(start) + F.col("k") * hop)


def reframed(df: DataFrame, key: str, tick: str, size: int) -> DataFrame:
    """Reads of any length cut into frames by their samples' global place: frame and place in it."""
    return df.withColumn("frame", F.floor(F.col(tick) / size).cast("long")).withColumn("at", (F.col(tick) % size).cast("long"))


def mixed_offsets(n: Column, size: int, stride: int, most: int) -> Column:
    """Up to `most` offsets at a fixed stride that leave a full window."""
    return F.when(n >= size, F.slice(F.sequence(F.lit(0), n - size, F.lit(stride)), 1, most)).otherwise(F.array().cast("array<int>"))
