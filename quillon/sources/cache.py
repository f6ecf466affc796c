"""Tables made from files, kept with a fingerprint of what they were made from: used again as long as that is the same, made anew otherwise."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.sinks import swap


def file_table(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (below the folder), size, mtime of all files below it; their content isn't read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))


def set_hash(df: DataFrame) -> str:
    """A hash of a table's rows as a bag: the same in any order and partitioning. Tasks sum up the two halves of each row's md5 and their exclusive ors, so that
    one row a task meets; equal rows count as often as they are there."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    halves = df.select(F.md5(row.cast("binary")).alias("h")).select(*[F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(20,0)").alias(n) for n, a in (("a", 1), ("b", 17))])
    sums = [f(c).alias(f"{n}{c}") for n, f in (("s", F.sum), ("x", lambda c: F.bit_xor(F.col(c).cast("long")))) for c in ("a", "b")]
    r = halves.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return hashlib.sha256("|".join(str(v) for v in r).encode()).hexdigest()


def fingerprint(files: DataFrame, config: dict, more: DataFrame | None = None) -> str:
    """Of files (path, size, mtime), of the settings that what is made depends on, and of a table that goes into it by its rows."""
    parts = [json.dumps(config, sort_keys=True), set_hash(files), set_hash(more) if more is not None else ""]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _text(spark: SparkSession, path: str) -> str | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = spark.read.schema("value string").text(path).take(1) if fs.exists(at) else []
    return rows[0][0] if rows else None


def fresh(spark: SparkSession, place: str, mark: str) -> bool:
    """Whether a whole table with this fingerprint is there."""
    return _text(spark, f"{place}/fingerprint") == mark


def cached(spark: SparkSession, place: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at a place under a fingerprint; where there is none, or one of another fingerprint, make() is written there first. The new table is written beside
    the old one and takes its place when it is whole, its fingerprint last, so that a run that ends in between leaves the old or the new one."""
    if not fresh(spark, place, mark):
        staged = f"{place.rstrip('/')}.{mark[:16]}"
        make().write.mode("overwrite").parquet(f"{staged}/rows")
        spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{staged}/fingerprint")
        swap(spark, [(staged, place)])
    return spark.read.parquet(f"{place}/rows")
