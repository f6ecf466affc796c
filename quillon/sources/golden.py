"""Golden files: samples, features and quantised features of fixed sizes as typed binary records, read and written as a data source.

A file is a header (records, samples a record, features a record as 32-bit integers, scale as a 32-bit float, zero point as a 32-bit integer), then
its records: 16-bit samples, 32-bit float features, 8-bit quantised features; all little-endian. Each task writes files of at most `records` records, which
appear when the job is committed; a reading task takes a stretch of a file's records."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillon.sources.wav import file_system

HEADER = np.dtype([("count", "<i4"), ("samples", "<i4"), ("features", "<i4"), ("scale", "<f4"), ("zero_point", "<i4")])
SUFFIX = ".golden"


def record(samples: int, features: int) -> np.dtype:
    return np.dtype([("x", "<i2", (samples,)), ("features", "<f4", (features,)), ("q", "i1", (features,))])


@dataclass
class Records(InputPartition):
    path: str
    first: int
    end: int


class GoldenReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.most = options["path"], int(options.get("records", 1000))

    def partitions(self) -> list[Records]:
        fs, at = file_system(self.folder)
        out = []
        for i in sorted(fs.get_file_info(pafs.FileSelector(at, recursive=True)), key=lambda i: i.path):
            if i.is_file and i.path.endswith(SUFFIX):
                with fs.open_input_file(i.path) as f:
                    n = int(np.frombuffer(f.read(HEADER.itemsize), HEADER)["count"][0])
                out += [Records(i.path, a, min(n, a + self.most)) for a in range(0, n, self.most)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = file_system(self.folder)
        with fs.open_input_file(partition.path) as f:
            h = np.frombuffer(f.read(HEADER.itemsize), HEADER)[0]
            kind = record(int(h["samples"]), int(h["features"]))
            f.seek(HEADER.itemsize + partition.first * kind.itemsize)
            rows = np.frombuffer(f.read((partition.end - partition.first) * kind.itemsize), kind)
            if len(rows) < partition.end - partition.first:
                raise ValueError(f"{partition.path} ends before its {h['count']} records")
            for k, r in enumerate(rows):
                yield partition.path, partition.first + k, r["x"].tolist(), r["features"].tolist(), r["q"].tolist(), float(h["scale"]), int(h["zero_point"])


@dataclass
class Wrote(WriterCommitMessage):
    files: list[str]


class GoldenWriter(DataSourceWriter):
    """Files are written under a name of their own and get their suffix when all tasks have ended."""

    def __init__(self, options, overwrite: bool):
        self.folder, self.most, self.overwrite = options["path"], int(options.get("records", 1000)), overwrite
        self.scale, self.zero_point = float(options["scale"]), int(options["zero_point"])

    def write(self, iterator) -> Wrote:
        fs, at = file_system(self.folder)
        fs.create_dir(at, recursive=True)
        files: list[str] = []
        rows: list[tuple] = []

        def put() -> None:
            sizes = {(len(x), len(f), len(q)) for x, f, q in rows}
            if len(sizes) > 1 or next(iter(sizes))[1] != next(iter(sizes))[2]:
                raise ValueError(f"records of different sizes: {sorted(sizes)}")
            n, m, _ = sizes.pop()
            out = np.array(rows, record(n, m))
            files.append(f"{at.rstrip('/')}/{uuid.uuid4().hex}")
            with fs.open_output_stream(files[-1]) as f:
                f.write(np.array([(len(rows), n, m, self.scale, self.zero_point)], HEADER).tobytes())
                f.write(out.tobytes())
            rows.clear()

        for r in iterator:
            rows.append((r["x"], r["features"], r["q"]))
            if len(rows) == self.most:
                put()
        if rows:
            put()
        return Wrote(files)

    def commit(self, messages: list[Wrote]) -> None:
        fs, at = file_system(self.folder)
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                if i.path.endswith(SUFFIX):
                    fs.delete_file(i.path)
        for m in messages:
            for path in m.files:
                fs.move(path, path + SUFFIX)

    def abort(self, messages: list[Wrote]) -> None:
        fs, _ = file_system(self.folder)
        for m in messages:
            for path in m.files if m else []:
                fs.delete_file(path)


class Golden(DataSource):
    """Options: path (folder), records (of a file, or read by a task); to write also scale and zero_point. Columns x, features and q are needed to write."""

    @classmethod
    def name(cls) -> str:
        return "golden_records"

    def schema(self) -> str:
        return "path string, record bigint, x array<smallint>, features array<float>, q array<tinyint>, scale float, zero_point int"

    def reader(self, schema) -> GoldenReader:
        return GoldenReader(self.options)

    def writer(self, schema, overwrite: bool) -> GoldenWriter:
        return GoldenWriter(self.options, overwrite)


def read_golden(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(Golden)
    return spark.read.format("golden_records").options(path=folder, **options).load()


def write_golden(df: DataFrame, folder: str, scale: float, zero_point: int, mode: str = "overwrite", records: int = 1000) -> None:
    df.sparkSession.dataSource.register(Golden)
    rows = df.selectExpr("CAST(x AS ARRAY<SMALLINT>) AS x", "CAST(features AS ARRAY<FLOAT>) AS features", "CAST(q AS ARRAY<TINYINT>) AS q")
    rows.write.format("golden_records").mode(mode).options(path=folder, scale=scale, zero_point=zero_point, records=records).save()
