"""WAV recordings by byte range: a window needs the header and its own samples only, not the rest of its file.

`wav_windows` is a data source of fixed-stride windows (path, offset, x, error). Its partitions are stretches of bytes: long files are split,
short ones put together; filters on path and offset are pushed to the listing and to the places read. Files are opened by Arrow's
file systems (local, HDFS, S3, GCS), so that tasks read ranges without Spark holding whole files."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quillon.functions.resample import length_at, needed, resample

RATE, SIZE = 16_000, 16_000
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    kind: int
    bits: int
    start: int  # of the samples, in bytes
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8


def read_header(f, length: int) -> Header:
    """The header of a file of a length in bytes; raises ValueError if there is none that can be read."""
    f.seek(0)
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    form = None
    while len(chunk := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", chunk)
        if name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            kind, channels, rate, bits = form
            start = f.tell()
            if (kind, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)} or not channels or not rate:
                raise ValueError(f"samples of format {kind} with {bits} bits")
            return Header(rate, channels, kind, bits, start, min(size, length - start) // (channels * bits // 8))
        if name == b"fmt ":
            raw = f.read(size)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            form = (struct.unpack("<H", raw[24:26])[0] if kind == EXTENSIBLE and len(raw) >= 26 else kind, channels, rate, bits)
            size -= len(raw)
        f.seek(f.tell() + size + (size & 1))
    raise ValueError("no samples")


def to_floats(raw: bytes, h: Header) -> np.ndarray:
    """Mono floats of whole frames: the mean of the channels."""
    raw = raw[: len(raw) // h.frame_bytes * h.frame_bytes]
    if h.kind == FLOAT:
        x = np.frombuffer(raw, f"<f{h.bits // 8}").astype(np.float64)
    elif h.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif h.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{h.bits // 8}") / float(1 << (h.bits - 1))
    return x.reshape(-1, h.channels).mean(1)


class Wav:
    """An open recording at a rate of one's own."""

    def __init__(self, f, length: int, rate: int = RATE):
        self.f, self.header, self.rate = f, read_header(f, length), rate
        self.n = length_at(self.header.frames, self.header.rate, rate)

    def samples(self, offset: int = 0, size: int | None = None) -> np.ndarray:
        """Samples offset to offset + size - 1; zeros beyond the ends."""
        h, size = self.header, self.n - offset if size is None else size
        a, b = needed(offset, size, h.rate, self.rate) if size > 0 else (0, 0)
        a, b = max(0, a), min(h.frames, b)
        if a >= b:
            return np.zeros(max(0, size))
        self.f.seek(h.start + a * h.frame_bytes)
        x = to_floats(self.f.read((b - a) * h.frame_bytes), h)
        # outputs past the last input are none, though the filter's end reaches there
        out = resample(x, h.rate, self.rate, offset, min(size, max(0, self.n - offset)), a)
        return np.concatenate((out, np.zeros(size - len(out))))


def of_bytes(data: bytes, rate: int = RATE) -> Wav:
    return Wav(io.BytesIO(data), len(data), rate)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it. Spark writes file:/a for file:///a."""
    return pafs.FileSystem.from_uri("file:///" + path[6:].lstrip("/") if path.startswith("file:/") else path)


def open_wav(path: str, rate: int) -> Wav:
    fs, at = file_system(path)
    return Wav(fs.open_input_file(at), fs.get_file_info(at).size, rate)


def load_windows(windows: DataFrame, folder: str | None = None, path: str = "path", offset: str = "offset", size: int = SIZE, rate: int = RATE, to: str = "x") -> DataFrame:
    """Read each window of a table again: adds its samples (null where the file can't be read, or path or offset is null). Paths are below
    folder, if one is given. Windows stay in their partitions and are sorted there, so that a file is opened once for its neighbouring windows."""
    schema = T.StructType([*[f for f in windows.schema if f.name != to], T.StructField(to, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema][:-1]

    def read(batches):
        last, wav = None, None
        for batch in batches:
            out = []
            for p, o in zip(batch.column(names.index(path)).to_pylist(), batch.column(names.index(offset)).to_pylist()):
                if p is not None and p != last:
                    try:
                        last, wav = p, open_wav(f"{folder.rstrip('/')}/{p}" if folder else p, rate)
                    except Exception:  # what a file holds is not known before; errors_of() of the listing says what is wrong
                        last, wav = p, None
                out.append(None if p is None or o is None or wav is None else wav.samples(o, size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*names, to])

    return windows.select(*[f"`{c}`" for c in names]).sortWithinPartitions(path, offset).mapInArrow(read, schema)


@dataclass
class Stretch(InputPartition):
    """Files with the bytes of each in which a window must begin."""

    files: list[tuple[str, int, int, int]]  # path, length, from, to


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.rate, self.size = int(options.get("rate", RATE)), int(options.get("size", SIZE))
        self.hop = int(options.get("hop", self.size))
        self.split = int(float(options.get("split_mb", 32)) * (1 << 20))
        self.suffix = options.get("suffix", ".wav")
        self.paths: set[str] | None = None
        self.low, self.high = 0, None
        self.offsets: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("path",) and isinstance(f, (EqualTo, In)):
                some = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = some if self.paths is None else self.paths & some
            elif column == ("offset",) and isinstance(f, (EqualTo, In)):
                some = {value} if isinstance(f, EqualTo) else set(value)
                self.offsets = some if self.offsets is None else self.offsets & some
            elif column == ("offset",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif column == ("offset",) and isinstance(f, (LessThan, LessThanOrEqual)):
                end = value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        fs, at = file_system(self.folder)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        files = sorted((i.path, i.size) for i in found if i.is_file and i.path.endswith(self.suffix))
        prefix = self.folder[: len(self.folder) - len(at)] if self.folder.endswith(at) else ""
        out, held = [], 0
        for p, n in files:
            if self.paths is not None and prefix + p not in self.paths:
                continue
            for a in range(0, max(n, 1), self.split):
                b = min(n, a + self.split)
                if not out or held + b - a > self.split:
                    out.append(Stretch([]))
                    held = 0
                out[-1].files.append((prefix + p, n, a, b))
                held += b - a
        return out or [Stretch([])]

    def _wanted(self, wav: Wav, a: int, b: int) -> Iterator[int]:
        """The offsets of windows that begin in these bytes: full ones, or the first of a recording that is shorter."""
        h = wav.header
        end = max(1, wav.n - self.size + 1)
        end = end if self.high is None else min(end, self.high)
        if self.offsets is not None:
            some = sorted(o for o in self.offsets if self.low <= o < end and o % self.hop == 0)
        else:
            some = range(-(-max(0, self.low) // self.hop) * self.hop, end, self.hop)
        for o in some:
            at = h.start + o * h.rate // self.rate * h.frame_bytes
            if (at >= a or a == 0) and at < b:
                yield o

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for path, _, a, b in partition.files:
            try:
                wav = open_wav(path, self.rate)
            except Exception as e:
                if a == 0:
                    yield path, None, None, f"{type(e).__name__}: {e}"
                continue
            for o in self._wanted(wav, a, b):
                yield path, o, wav.samples(o, self.size).tolist(), None


class WavWindows(DataSource):
    """Options: path (folder), rate, size and hop in samples, split_mb, suffix."""

    @classmethod
    def name(cls) -> str:
        return "wav_windows"

    def schema(self) -> str:
        return "path string, offset bigint, x array<double>, error string"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read_wav_windows(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Fixed-stride windows of all recordings below a folder; see WavWindows. Files that can't be read are a row with their error."""
    spark.dataSource.register(WavWindows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("wav_windows").options(path=folder, **options).load()
