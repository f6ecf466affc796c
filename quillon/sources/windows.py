"""From a folder of recordings to a table of windows: each source has a rule for its files, labels, groups and the windows it gives.

Rules are a table (rows of SourceRule, or a file of such rows). Files meet the first rule whose expression fits their path; labels, groups
and categories are SQL over the parts of the path and the columns of a lookup file; offsets are taken from the recording itself:

  peaks    the loudest frames that rise over the one before and don't fall below the one after, over the LOUD percentile, apart from each other
  loudest  the loudest frame, then a random place (drawn by a hash of the path, so that reruns agree)
  stride   every so many seconds
  centre   the middle

A window is centred on its frame, stays within the recording and is filled up with zeros if that is shorter; equal offsets count once and
digitally silent windows are left out. Recordings are read and decoded by the tasks, one at a time; none of a source's rows meet."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.hashing import uniform
from quillon.sources import wav
from quillon.sources.audio import DatasetMissing

KINDS = ("peaks", "loudest", "stride", "centre")
FRAME, LOUD, SILENT_DB = 512, 60.0, -80.0


@dataclass(frozen=True)
class SourceRule:
    """files: a regular expression that a path below the folder matches as a whole. label, group and category: SQL over path, folder (the one
    above the file), file, stem and, with a lookup, the columns of its CSV file (a path below the folder), whose column lookup_key holds the
    file's name; files without a row there are left out. most: SQL for the number of windows, which may use label."""

    source: str
    files: str
    label: str
    group: str
    category: str
    offsets: str = "centre"
    most: str = "1"
    apart_s: float = 0.0
    stride_s: float = 0.0
    lookup: str | None = None
    lookup_key: str = "filename"

    def __post_init__(self):
        if self.offsets not in KINDS:
            raise ValueError(f"{self.source}: {self.offsets} is none of {', '.join(KINDS)}")


RULE_SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c.endswith("_s") else T.StringType()) for c in SourceRule.__dataclass_fields__])


def rules_of(table: DataFrame) -> list[SourceRule]:
    """The rules of a table in the order of their sources."""
    missing = {"source", "files", "label", "group", "category"} - set(table.columns)
    if missing:
        raise ValueError(f"rules lack {', '.join(sorted(missing))}")
    return [SourceRule(**{k: v for k, v in r.asDict().items() if k in SourceRule.__dataclass_fields__ and v is not None}) for r in table.orderBy("source").collect()]


def rules_table(spark: SparkSession, rules: list[SourceRule]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rules], RULE_SCHEMA)


def frame_levels(x: np.ndarray) -> np.ndarray:
    n = len(x) // FRAME
    if not n:
        return np.full(1, -120.0)
    return 20 * np.log10(np.sqrt((x[: n * FRAME].reshape(n, FRAME) ** 2).mean(1)) + 1e-9)


def _around(frame: int, n: int, size: int) -> int:
    return int(np.clip(frame * FRAME + FRAME // 2 - size // 2, 0, max(0, n - size)))


def peak_offsets(x: np.ndarray, most: int, apart: int, size: int) -> list[int]:
    level = frame_levels(x)
    if len(level) < 3 or most <= 0:
        return []
    middle = level[1:-1]
    rises = np.flatnonzero((middle >= np.percentile(level, LOUD)) & (middle > level[:-2]) & (middle >= level[2:])) + 1
    taken: list[int] = []
    for i in rises[np.argsort(-level[rises], kind="stable")].tolist():
        if len(taken) < most and all(abs(i - j) * FRAME >= apart for j in taken):
            taken.append(i)
    return [_around(i, len(x), size) for i in taken]


def offsets_of(x: np.ndarray, kind: str, most: int, apart_s: float, stride_s: float, draw: float, rate: int, size: int) -> list[int]:
    """The offsets a rule gives for a recording, each once. draw: a number from 0 to 1 for the random place."""
    spare = max(0, len(x) - size)
    if kind == "peaks":
        found = peak_offsets(x, most, int(apart_s * rate), size)
    elif kind == "loudest":
        found = [_around(int(np.argmax(frame_levels(x))), len(x), size), min(spare, int(draw * (spare + 1)))][:most]
    elif kind == "stride":
        found = list(range(0, spare + 1, max(1, int(stride_s * rate))))[:most]
    else:
        found = [spare // 2][:most]
    return list(dict.fromkeys(found))


def silent(x: np.ndarray) -> bool:
    return 20 * np.log10(np.sqrt(np.mean(x**2)) + 1e-9) < SILENT_DB


def _listed(spark: SparkSession, folder: str, rules: list[SourceRule], seed: int) -> DataFrame:
    """Each file with a rule: path (below the folder), source, label, group, category, the rule's numbers, draw and content."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise DatasetMissing(folder)
    root = fs.makeQualified(hadoop).toString()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    rows = files.select(F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path")).alias("path"), F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "content")
    rows = rows.withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
    fits = [F.when(F.col("path").rlike(f"^(?:{r.files})$"), F.lit(k)) for k, r in enumerate(rules)]
    rows = rows.withColumn("__rule", F.coalesce(*fits)).where("__rule IS NOT NULL")
    for k, r in enumerate(rules):
        if r.lookup:  # its columns take names of their own, so that lookups don't clash
            table = spark.read.csv(f"{folder.rstrip('/')}/{r.lookup}", header=True).dropDuplicates([r.lookup_key])
            table = table.select(F.col(f"`{r.lookup_key}`").alias(f"__key{k}"), F.struct("*").alias(f"__look{k}"))
            rows = rows.join(table, (F.col("__rule") == k) & (F.col("file") == F.col(f"__key{k}")), "left").where((F.col("__rule") != k) | F.col(f"__key{k}").isNotNull())

    def by_rule(make) -> F.Column:
        return F.coalesce(*[F.when(F.col("__rule") == k, make(k, r)) for k, r in enumerate(rules)])

    def of(k: int, r: SourceRule, text: str) -> F.Column:
        if r.lookup:  # the lookup's columns by their own names
            for c in spark.read.csv(f"{folder.rstrip('/')}/{r.lookup}", header=True).columns:
                text = _named(text, c, f"__look{k}.`{c}`")
        return F.expr(text)

    rows = rows.withColumn("label", by_rule(lambda k, r: of(k, r, r.label).cast("int")))
    return rows.select(
        "path", by_rule(lambda k, r: F.lit(r.source)).alias("source"), "label",
        by_rule(lambda k, r: of(k, r, r.group).cast("string")).alias("group"), by_rule(lambda k, r: of(k, r, r.category).cast("string")).alias("category"),
        F.struct(
            by_rule(lambda k, r: F.lit(r.offsets)).alias("kind"), by_rule(lambda k, r: of(k, r, r.most).cast("int")).alias("most"),
            by_rule(lambda k, r: F.lit(float(r.apart_s))).alias("apart_s"), by_rule(lambda k, r: F.lit(float(r.stride_s))).alias("stride_s"),
            uniform(seed, F.col("path")).alias("draw"),
        ).alias("rule"),
        "content",
    )


def _named(text: str, column: str, to: str) -> str:
    """A column's name in an SQL text, where it isn't within quotes or a longer name, under another name."""
    import re

    parts = re.split(r"('(?:[^']|'')*')", text)
    return "".join(p if p.startswith("'") else re.sub(rf"(?<![\w.`]){re.escape(column)}(?![\w`(])", lambda m: to, p) for p in parts)


WINDOW = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("label", T.IntegerType()),
    T.StructField("group", T.StringType()), T.StructField("category", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType()),
])


def source_windows(spark: SparkSession, folder: str, rules: list[SourceRule], rate: int = wav.RATE, size: int = wav.SIZE, seed: int = 0) -> DataFrame:
    """source, path, offset, label, group, category, x, error: the windows of all files below the folder that a rule takes; a file
    that can't be read is one row with its error and neither offset nor samples."""
    names = WINDOW.fieldNames()

    def cut(batches):
        for batch in batches:
            for row in (dict(zip(batch.schema.names, v)) for v in zip(*[c for c in batch.columns])):
                of_file = {c: row[c].as_py() for c in ("source", "path", "label", "group", "category")}
                out = []
                try:
                    x = wav.of_bytes(row["content"].as_py(), rate).samples()
                    rule = row["rule"].as_py()
                    for o in offsets_of(x, rule["kind"], rule["most"] or 0, rule["apart_s"], rule["stride_s"], rule["draw"], rate, size):
                        part = x[o : o + size]
                        part = np.concatenate((part, np.zeros(size - len(part))))
                        if not silent(part):
                            out.append(of_file | {"offset": o, "x": part, "error": None})
                except Exception as e:  # what a file holds is not known before
                    out = [of_file | {"offset": None, "x": None, "error": f"{type(e).__name__}: {e}"}]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, _ARROW)], names=names)

    return _listed(spark, folder, rules, seed).mapInArrow(cut, WINDOW)


_ARROW = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string()]
