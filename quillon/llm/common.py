"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's, DuckDB's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a lookup table that are few enough to send to every executor (each a short key and some numbers).
BROADCAST_ROWS = 100_000

#: Bytes of an Arrow batch of texts (one text at least): a batch is held by the JVM and by Python at once.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000

_written: list[tuple[SparkSession, str]] = []


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and all tasks run on this machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of texts, where the session hasn't set its own bounds."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def cuts() -> int:
    """How many tables of cut() there are."""
    return len(_written)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later steps start from the files."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(since: int = 0, last: int = 0) -> None:
    """Remove the tables of cut() but the first since and the last ones; results that still depend on them can't be read afterwards."""
    gone = _written[since : len(_written) - last]
    del _written[since : len(_written) - last]
    for spark, path in gone:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before
            return


atexit.register(drop_cuts)


def lookup(df: DataFrame, small: DataFrame, on: str, rows: int | None = None) -> DataFrame:
    """Left join with null-safe equality on one column. small goes to all executors if it has few rows
    (counted here unless given); else Spark joins, and splits skewed keys, as it finds the sizes."""
    right = small.withColumnRenamed(on, "__on")
    if (small.count() if rows is None else rows) <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return df.join(right, df[on].eqNullSafe(right["__on"]), "left").drop("__on")


#: A key is hot if it has 1 / HOT of all rows; so there are at most HOT hot keys.
HOT = 1000


def with_hot(rows: DataFrame, table: DataFrame, on: str, n: str) -> DataFrame:
    """rows left joined with table (one row a key, n: how many of rows have it) on one column. The table's rows of hot keys, HOT at
    most, go to all executors, so that the rows of a hot key needn't meet in one task; the others are joined by a shuffle."""
    total = table.agg(F.sum(n)).first()[0] or 0
    others = [c for c in table.columns if c not in (on, n)]
    hot = F.broadcast(table.where(F.col(n) * HOT >= total).select(on, F.struct(*others).alias("__hot")))
    marked = rows.join(hot, on, "left")
    few = marked.where("__hot IS NULL").drop("__hot").join(table.where(F.col(n) * HOT < total).drop(n), on, "left")
    return few.select(*rows.columns, *others).union(marked.where("__hot IS NOT NULL").select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in others]))
