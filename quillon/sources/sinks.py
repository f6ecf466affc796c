"""Outputs: reports, payloads, and directory swaps that roll back."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.written import kept
from quillon.sources.audio import encode_wav
from quillon.sources.tables import check_version
from quillon.sources.wav import file_system

NOTE_CHARS = 1000


def to_cloud_event(df: DataFrame, note: list[str], p: str = "p") -> DataFrame:
    """p clamped to 0..1 with three decimals; the other fields as compact JSON in note, null if that is too long."""
    text = F.to_json(F.struct(*note))
    return df.withColumn(p, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(p, 3)))).withColumn("note", F.when(F.length(text) <= NOTE_CHARS, text)).drop(*note)


#: Fixed value: the kind of event that the cloud takes.
EVENT_TYPE = "snore_detected"


def cloud_events(df: DataFrame, version: str) -> DataFrame:
    """The payload of each episode: device_id, timestamp (whole seconds), event_type, snore_duration_sec (one decimal), snore_confidence (0 to 1, three decimals), in_bed,
    body_motion_level (0 to 1), model_version and note, compact JSON of side, lag_ms, doa_conf, n_bursts and level_dbfs.

    df: device_id, ts, duration_s, mean_p and, where they are known, n_bursts, level_dbfs, side, lag_ms, doa_conf, presence and motion (null or missing: the
    value for unknown). A note of over NOTE_CHARS ends the job, as the cloud would refuse it; so does a version that it takes for simulated data."""
    check_version(version)
    known = lambda c, default: F.coalesce(F.col(c), default) if c in df.columns else default
    zero = F.lit(0.0)
    note = F.to_json(
        F.struct(
            known("side", F.lit("unknown")).alias("side"), F.round(known("lag_ms", zero), 3).alias("lag_ms"), F.round(known("doa_conf", zero), 3).alias("doa_conf"),
            known("n_bursts", F.lit(0)).cast("int").alias("n_bursts"), F.round(known("level_dbfs", zero), 1).alias("level_dbfs"),
        )
    )
    within = lambda x: F.greatest(zero, F.least(F.lit(1.0), x))
    return df.select(
        "device_id", F.floor("ts").cast("long").alias("timestamp"), F.lit(EVENT_TYPE).alias("event_type"), F.round("duration_s", 1).alias("snore_duration_sec"),
        F.round(within(F.col("mean_p")), 3).alias("snore_confidence"), known("presence", F.lit(True)).alias("in_bed"), within(known("motion", zero)).alias("body_motion_level"),
        F.lit(version).alias("model_version"), F.when(F.length(note) <= NOTE_CHARS, note).otherwise(F.raise_error(F.lit("a note exceeds the cloud's limit"))).alias("note"),
    )


def pivot_report(df: DataFrame, keys: list[str], split: str, splits: list[str]) -> str:
    """A Markdown table of counts. It has a row for each key, which must be few."""
    rows = df.groupBy(*keys).pivot(split, splits).count().na.fill(0, splits).orderBy(*keys).collect()
    lines = ["| " + " | ".join([*keys, *splits]) + " |", "|" + "---|" * (len(keys) + len(splits))]
    return "\n".join([*lines, *["| " + " | ".join(str(x) for x in r) + " |" for r in rows]])


def write_json(path: str, value: dict) -> None:
    """A file that is there whole or not at all."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(tmp, path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_manifest(df: DataFrame, path: str, columns: list[str]) -> None:
    # a quote within a field is doubled, as other readers expect
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def swap(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Put each staged folder in its place; if one rename fails, all go back. Works on any store that Spark writes to."""
    done = []
    try:
        for staged, place in pairs:
            fs, new = _fs(spark, staged)
            _, at = _fs(spark, place)
            _, old = _fs(spark, place + ".old")
            if not fs.exists(new):
                raise FileNotFoundError(staged)
            fs.delete(old, True)
            had = fs.exists(at) and fs.rename(at, old)
            done.append((fs, new, at, old, had))
            if not fs.rename(new, at):
                raise OSError(f"{staged} can't be put at {place}")
    except Exception:
        for fs, new, at, old, had in reversed(done):
            if fs.exists(at) and not fs.exists(new):
                fs.rename(at, new)
            if had:
                fs.rename(old, at)
        raise
    for fs, _, _, old, _ in done:
        fs.delete(old, True)


def deploy(spark: SparkSession, place: str, model: str, metrics: dict, threshold: dict) -> None:
    """Put a model's file, its metrics and its threshold in their place as one generation, the threshold bound to the file by its SHA-256; the generation before
    stays if anything fails. The model is a file on the driver, the place any folder that Spark writes to."""
    with open(model, "rb") as f:
        data = f.read()
    staged = f"{place}.new"
    fs, new = _fs(spark, staged)
    fs.delete(new, True)
    texts = {"metrics.json": metrics, "threshold.json": threshold | {"model_sha256": hashlib.sha256(data).hexdigest()}}
    for name, content in {os.path.basename(model): data, **{n: json.dumps(v, indent=2).encode() for n, v in texts.items()}}.items():
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{staged}/{name}"), True)
        out.write(bytearray(content))
        out.close()
    swap(spark, [(staged, place)])


def write_chunks(blocks: DataFrame, folder: str, rate: int, size: int, key: str = "key", first: str = "first", samples: str = "samples") -> DataFrame:
    """Write each key's samples as WAV files of size samples, the last one of what is left, and return (key, chunk, path, n). blocks: stretches of samples and the place of
    their first; they may be cut anywhere, but together leave no gap. A task holds a chunk."""
    place = F.col(first)
    ids = F.sequence(F.floor(place / size), F.floor((place + F.size(samples) - 1) / size))
    parts = blocks.where(F.size(samples) > 0).select(F.col(key).alias("key"), place.alias("first"), F.col(samples).cast("array<double>").alias("x"), F.explode(ids).alias("chunk"))
    begin = F.greatest(F.col("first"), F.col("chunk") * size)
    end = F.least(F.col("first") + F.size("x"), (F.col("chunk") + 1) * size)
    parts = parts.select("key", "chunk", (begin - F.col("chunk") * size).alias("at"), F.slice("x", (begin - F.col("first") + 1).cast("int"), (end - begin).cast("int")).alias("x"))
    kind = parts.schema["key"].dataType

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        k, c = group.column("key")[0].as_py(), group.column("chunk")[0].as_py()
        x = np.concatenate([v.values.to_numpy(zero_copy_only=False) for v in group.column("x")])
        fs, at = file_system(folder)
        path = f"{at.rstrip('/')}/{k}/chunk_{c:04d}.wav"
        fs.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"  # under a name of its own until it is whole, as a task may run twice
        with fs.open_output_stream(part) as f:
            f.write(encode_wav(x, rate))
        fs.move(part, path)
        return pa.table({"key": group.column("key").slice(0, 1), "chunk": pa.array([c], pa.int64()), "path": pa.array([path]), "n": pa.array([len(x)], pa.int64())})

    schema = T.StructType([T.StructField("key", kind), T.StructField("chunk", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n", T.LongType())])
    return kept(parts.groupBy("key", "chunk").applyInArrow(write, schema))


class Ledger:
    """Who has read the test split of a manifest with a model: each pair once."""

    def __init__(self, path: str):
        self.path = path

    def claim(self, manifest_sha: str, model_sha: str) -> bool:
        seen = json.load(open(self.path)) if os.path.exists(self.path) else {}
        key = f"{manifest_sha}:{model_sha}"
        if key in seen:
            return False
        write_json(self.path, seen | {key: True})
        return True


def class_status(df: DataFrame, label: str, length: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum(length) / 1e6, 3).alias("mb"))
