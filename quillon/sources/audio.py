"""Recordings as rows: WAV files by class folder, decoded in tasks; files that can't be decoded are rows with an error."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.noise import FAMILIES, noise_column, voiced_column
from quillon.functions.resample import fft_resample, resample


class DatasetMissing(FileNotFoundError):
    """A source that must be there isn't."""


METHODS = ("linear", "sinc", "fft")


def decode_wav(data: bytes, rate: int, method: str = "linear", channel: str = "mean") -> np.ndarray:
    """Mono floats at a rate: 16-bit PCM only, the mean of the channels or the left one; resampled by linear interpolation, a windowed
    sinc or the spectrum."""
    if method not in METHODS or channel not in ("mean", "left"):
        raise ValueError(f"{method}, {channel}")
    with wave.open(io.BytesIO(data)) as f:
        if f.getsampwidth() != 2:
            raise ValueError(f"{8 * f.getsampwidth()}-bit samples")
        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
        x = (x[:, 0] if channel == "left" else x.mean(1)) / 32768.0
        own = f.getframerate()
    if own == rate or not len(x):
        return x
    if method == "sinc":
        return resample(x, own, rate)
    n = int(round(len(x) * rate / own))
    return fft_resample(x, n) if method == "fft" else np.interp(np.arange(n) * own / rate, np.arange(len(x)), x)


def fitted(x: np.ndarray, size: int) -> np.ndarray:
    """The middle of a series that is longer than size; a shorter one with zeros after it."""
    first = max(0, len(x) - size) // 2
    return np.concatenate((x[first : first + size], np.zeros(max(0, size - len(x)))))


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_recordings(spark: SparkSession, folders: list[tuple[str, str]], rate: int = 16000, pattern: str = "*.wav", strict_rate: bool = False, method: str = "linear", channel: str = "mean", size: int | None = None) -> DataFrame:
    """path, source, label_dir (the folder above the file), length, samples, error; folders: (path, source). Missing folders are skipped.
    With a size, recordings are cut to their middle or filled up to it."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for path, source in folders:
        at = fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
            parts.append(files.select("path", F.lit(source).alias("source"), "length", "content"))
    if not parts:
        raise DatasetMissing(str([p for p, _ in folders]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    @F.arrow_udf("struct<samples: array<double>, error: string>")
    def decode(contents: pa.Array) -> pa.Array:
        out = []
        for c in contents:
            try:
                if strict_rate:
                    with wave.open(io.BytesIO(c.as_py())) as f:
                        if f.getframerate() != rate:
                            raise ValueError(f"rate {f.getframerate()}")
                x = decode_wav(c.as_py(), rate, method, channel)
                out.append({"samples": (x if size is None else fitted(x, size)).tolist(), "error": None})
            except Exception as e:  # what a file holds is not known before
                out.append({"samples": None, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("samples", pa.list_(pa.float64())), ("error", pa.string())]))

    out = rows.withColumn("d", decode("content"))
    return out.select("path", "source", F.element_at(F.split("path", "/"), -2).alias("label_dir"), "length", "d.samples", "d.error")


def errors_of(df: DataFrame) -> DataFrame:
    return df.where("error IS NOT NULL").select("path", "error")


def require_sources(df: DataFrame, source: str, wanted: list[str]) -> None:
    """Raise unless each wanted source has a row."""
    have = {r[0] for r in df.where(F.col(source).isin(wanted)).select(source).distinct().collect()}
    if missing := sorted(set(wanted) - have):
        raise DatasetMissing(", ".join(missing))


def windows_of(df: DataFrame, size: int, hop: int, least_peak: float = 0.0) -> DataFrame:
    """Full windows of each recording that aren't silent: path, offset, x."""
    n = F.size("samples")
    rows = df.where(F.col("samples").isNotNull() & (n >= size))
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(0), n - size, F.lit(hop))))
    rows = rows.select("path", "source", "label_dir", "offset", F.slice("samples", F.col("offset") + 1, size).alias("x"))
    return rows.where(F.array_max(F.transform("x", F.abs)) >= least_peak)


SPAN_SCHEMA = "chunk string, start_s double, end_s double, label string, side string, posture string, distance_m double, pillow string"


def read_spans(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """Label spans of a CSV file; raises if a label is unknown, a span is empty or two overlap."""
    from quillon.operators.windowing import overlaps

    df = spark.read.csv(path, header=True, schema=SPAN_SCHEMA)
    bad = df.where(~F.col("label").isin(labels) | (F.col("end_s") <= F.col("start_s"))).limit(1).collect()
    if bad or overlaps(df, "chunk", "start_s", "end_s").limit(1).collect():
        raise ValueError(f"bad or overlapping spans in {path}: {bad}")
    return df


def synthetic_tones(spark: SparkSession, n: int, rate: int = 16000, seconds: float = 1.0, seed: int = 0) -> DataFrame:
    """id, x: low voiced tones (see noise.voiced)."""
    return spark.range(n).withColumn("x", voiced_column(F.col("id"), int(rate * seconds), rate, seed))


def synthetic_noise(spark: SparkSession, n: int, rate: int = 16000, seconds: float = 1.0, seed: int = 0) -> DataFrame:
    """id, family, x: the families of noise in turn."""
    rows = spark.range(n).withColumn("family", F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), (F.col("id") % len(FAMILIES) + 1).cast("int")))
    return rows.withColumn("x", noise_column(F.col("id"), F.col("family"), int(rate * seconds), rate, seed))
