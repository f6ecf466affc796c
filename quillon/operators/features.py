"""Feature matrices of a table of samples, with a guard of their shape and counts of what it leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import dsp


def has_shape(f: Column, frames: int, bands: int) -> Column:
    """Whether a matrix (array of frames) has these numbers; false for null."""
    return F.coalesce((F.size(f) == frames) & F.forall(f, lambda x: F.size(x) == bands), F.lit(False))


def feature_rows(df: DataFrame, samples: str, frames: int, spec: dsp.FeatureSpec = dsp.SPEC_1, to: str = "features") -> DataFrame:
    """Add the features and whether they are to be skipped: samples that are null or give another number of frames."""
    out = df.withColumn(to, dsp.log_mel_column(F.col(samples), spec))
    return out.withColumn("skipped", ~has_shape(F.col(to), frames, spec.mels))


def skip_counts(rows: DataFrame, label: str) -> DataFrame:
    """By label: rows, kept and skipped."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("skipped")).alias("kept"), F.count_if("skipped").alias("skipped"))
