"""Ranks and running sums over a whole table without bringing it to one task.

Rows are dealt by a bucket that grows with the order; each bucket is ranked or summed on its own, and the
totals of the buckets before it (a small table, one row a bucket) are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _starts(totals: DataFrame, names: list[str]) -> DataFrame:
    """Sums of the buckets before each. totals has one row a bucket, as many as buckets were chosen."""
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])


def global_rank(df: DataFrame, bucket: Column, order: list, to: str = "rank") -> DataFrame:
    """Add the place (from 1) of each row in the order. bucket: an integer that never falls along the order."""
    rows = df.withColumn("__b", bucket)
    starts = _starts(rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")), ["__n"])
    inner = rows.withColumn(to, F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    return inner.join(starts, "__b").withColumn(to, F.col(to) + F.col("__n")).drop("__b", "__n")


def running_sums(df: DataFrame, bucket: Column, order: list, sums: dict[str, str]) -> DataFrame:
    """Add running sums (up to and with the row) of columns along the order; sums: new name to column."""
    rows = df.withColumn("__b", bucket)
    starts = _starts(rows.groupBy("__b").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()]), [f"__{n}" for n in sums])
    run = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({n: F.sum(c).over(run) for n, c in sums.items()})
    return inner.join(starts, "__b").withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__b", *[f"__{n}" for n in sums])
