"""Tables beside recordings, as CSV or JSON: metadata, manifests, teacher scores, label templates, audits."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "filename string, fold int, target int, category string, esc10 boolean, src_file string, take string"
MANIFEST = "id bigint, source string, path string, offset bigint, label int, `group` string, category string, md5 string, dup_cluster bigint, split string"
SCORES = "id bigint, z double, flag string"
LABEL_SPANS = "chunk string, start_s double, end_s double, label string, side string, posture string, distance_m double, pillow string"
EXACT_DUPS = "kept_id bigint, kept_source string, id bigint, source string, path string, label int"

#: Model versions that the cloud takes for simulated data.
BANNED_VERSIONS = ("simulator", "demo", "mock")
#: An example row of the label template.
LABEL_EXAMPLE = ("chunk_0000.wav", 0.0, 10.0, "snore", "left", "supine", 0.8, "thin")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a given schema; a value that doesn't fit ends the job, as it would be lost else."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_scores(df: DataFrame, path: str, id: str = "id", z: str = "z", flag: str = "flag") -> None:
    """Teacher scores with six decimals."""
    write_csv(df.select(F.col(id).alias("id"), F.format_string("%.6f", F.col(z).cast("double")).alias("z"), F.coalesce(F.col(flag), F.lit("")).alias("flag")), path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SCORES).withColumn("flag", F.coalesce("flag", F.lit("")))


def write_label_template(spark: SparkSession, path: str) -> None:
    write_csv(spark.createDataFrame([LABEL_EXAMPLE], LABEL_SPANS), path)


def read_audit(spark: SparkSession, path: str, schema: str = EXACT_DUPS) -> DataFrame:
    """Rows of an audit kept as JSON lines; none where there is no such file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def relative_path(path: F.Column, root: str) -> F.Column:
    """A path below a root without the root; others as they are."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def version_banned(version: F.Column) -> F.Column:
    return F.lower(version).rlike("|".join(BANNED_VERSIONS))


def check_version(version: str) -> str:
    if any(b in version.lower() for b in BANNED_VERSIONS):
        raise ValueError(f"version {version!r} would be taken for simulated data")
    return version


def check_release(path: str, sha256: str, version: str) -> None:
    """Refuse a file that isn't the one that was measured, or a banned version. The file is on the driver."""
    import hashlib

    check_version(version)
    with open(path, "rb") as f:
        found = hashlib.sha256(f.read()).hexdigest()
    if found != sha256:
        raise ValueError(f"{os.path.basename(path)} has changed since it was measured")


def check_samples(df: DataFrame, least: int) -> int:
    """The number of rows; refuses fewer than least. No more than least rows are read."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} rows, at least {least} wanted")
    return n
