"""Tables written in between, in the folder that the driver and all executors share: later steps start from their files, also where an executor is lost."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder name where all executors can read and write; it is removed when the session's program ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(at)
    path = f"{at}/quillon-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked() -> int:
    """How many folders there are; for drop()."""
    return len(_written)


def drop(since: int = 0, last: int = 0) -> None:
    """Remove the folders made since a mark but the last ones. Results that still read them can't be made afterwards."""
    gone = _written[since : len(_written) - last]
    del _written[since : len(_written) - last]
    for spark, path in gone:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before
            return


atexit.register(drop)
