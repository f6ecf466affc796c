"""Samples, oversampling and batches; all draws are by hash, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.hashing import hash32
from quillon.operators.ranking import global_rank


def hash_ranked(df: DataFrame, id: str, seed, to: str = "rank") -> DataFrame:
    """Add the place of each row in the order of its hash (ties by id)."""
    return global_rank(df.withColumn("__h", hash32(seed, F.col(id))), F.shiftright("__h", 22), ["__h", id], to).drop("__h")


def hash_top(df: DataFrame, id: str, seed, n: int) -> DataFrame:
    """The n rows with the smallest hashes."""
    return df.orderBy(hash32(seed, F.col(id)), id).limit(n)


def downsample(df: DataFrame, id: str, label: str, seed, ratio: int = 2) -> DataFrame:
    """All rows with label 1 and ratio times as many of the others (fewer if there are fewer)."""
    n = df.where(F.col(label) == 1).agg((F.count(F.lit(1)) * ratio).alias("__n"))
    rest = hash_ranked(df.where(F.col(label) != 1), id, seed, "__k").join(F.broadcast(n)).where("__k <= __n").drop("__k", "__n")
    return df.where(F.col(label) == 1).unionByName(rest)


def oversample(df: DataFrame, label: str, copies: int = 2) -> DataFrame:
    """Each row with label 1 comes again copies times; copy 0 is the original."""
    return df.withColumn("copy", F.explode(F.when(F.col(label) == 1, F.sequence(F.lit(0), F.lit(copies))).otherwise(F.array(F.lit(0)))))


def balanced_batches(df: DataFrame, id: str, label: str, seed, batch: int) -> DataFrame:
    """Batches of batch // 3 rows with label 1 and the rest without; those with label 1 are used again in turn."""
    pos = batch // 3
    neg = batch - pos
    n = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    n = n.withColumn("batches", F.ceil(F.col("q") / neg))
    negatives = hash_ranked(df.where(F.col(label) != 1), id, seed).select(id, label, F.floor((F.col("rank") - 1) / neg).cast("long").alias("batch"))
    positives = hash_ranked(df.where(F.col(label) == 1), id, seed).join(F.broadcast(n))
    # the row of rank r fills the slots r - 1, r - 1 + p, ...
    slots = F.sequence(F.col("rank") - 1, F.col("batches") * pos - 1, F.col("p"))
    positives = positives.where(F.col("rank") - 1 <= F.col("batches") * pos - 1).withColumn("slot", F.explode(slots)).select(id, label, F.floor(F.col("slot") / pos).cast("long").alias("batch"))
    return negatives.unionByName(positives)


def first_per_key(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__k") <= n).drop("__k")
