"""Sample streams: raw files of 32-bit words that grow, read in blocks, and cut into frames whose unfinished rest waits for the next block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillon.sources.wav import file_system
from quillon.streaming.ordered import Machine, run_batch, run_stream

BLOCK, FRAME, RATE = 1024, 512, 16_000


@dataclass
class Blocks(InputPartition):
    path: str
    first: int
    end: int


class WordReader(DataSourceStreamReader):
    """Offsets are the whole blocks of each file that have been read; what a file has beyond its last whole block waits for more."""

    def __init__(self, options):
        self.folder, self.block, self.rate = options["path"], int(options.get("block", BLOCK)), int(options.get("rate", RATE))
        self.suffix = options.get("suffix", ".raw")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, at = file_system(self.folder)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        return {i.path: i.size // (4 * self.block) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return [Blocks(p, start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        import datetime

        fs, _ = file_system(self.folder)
        origin = datetime.datetime(2000, 1, 1, tzinfo=datetime.timezone.utc)
        with fs.open_input_file(partition.path) as f:
            for k in range(partition.first, partition.end):
                f.seek(4 * self.block * k)
                words = np.frombuffer(f.read(4 * self.block), "<i4")
                yield partition.path, k, origin + datetime.timedelta(seconds=k * self.block / self.rate), words.tolist()


class WordBlocks(DataSource):
    """Options: path (folder), block in words, rate, suffix. ts is when a block begins, counted from 2000-01-01."""

    @classmethod
    def name(cls) -> str:
        return "word_blocks"

    def schema(self) -> str:
        return "path string, seq bigint, ts timestamp, words array<int>"

    def streamReader(self, schema) -> WordReader:
        return WordReader(self.options)


def read_word_blocks(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of blocks of words of all raw files below a folder."""
    spark.dataSource.register(WordBlocks)
    return spark.readStream.format("word_blocks").options(path=folder, **options).load()


def framer(size: int = FRAME, forget_s: float = float("inf")) -> Machine:
    """Frames of 16-bit samples, the upper halves of the words; values are (words,). The rest of a key that ends is dropped, as it fills no frame."""

    def step(s: dict, t: float, v: tuple) -> list[dict]:
        samples = [*s["rest"], *((w >> 16) for w in v[0] or ())]
        whole = len(samples) // size
        out = [{"frame": s["frame"] + k, "samples": samples[k * size : (k + 1) * size]} for k in range(whole)]
        s["rest"], s["frame"] = samples[whole * size :], s["frame"] + whole
        return out

    return Machine(lambda: {"rest": [], "frame": 0}, step, "frame bigint, samples array<int>", forget_s=forget_s)


def stream_frames(blocks: DataFrame, key: str = "path", t: str = "ts", words: str = "words", size: int = FRAME, late: str = "10 seconds", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    return run_stream(blocks, key, t, [words], framer(size), late, order)


def batch_frames(blocks: DataFrame, key: str = "path", t: str = "ts", words: str = "words", size: int = FRAME, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    return run_batch(blocks, key, t, [words], framer(size), order)
