"""Distinct words of blocks of documents, joined globally.

Text has far more word places than distinct words, so the places stay in compact blocks: a block holds the words of
some documents once, and each document as positions into that list. Only the distinct words of a block are
shuffled, to the task of the word's hash, where all blocks' copies of a word meet; what is computed there once for each
distinct word goes back to the blocks, which put it at its positions.

Plan: one shuffle by block (the blocks; Spark reuses its files for both sides), one by word, one back. All are
spread evenly by hashes, whatever words or documents are frequent: a word comes once from each block. A task holds
one block, or the distinct words of one hash partition.

Why not a row for each (block, word): the text of 0.51 GB of Parquet has 165 million pre-tokens, and its blocks of 3 MB together 29 million
distinct ones; as rows, words, answers and places take over 2 times the input in shuffle files, these blocks 1.3 times.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import small_batches

#: Bytes of text in a block, more or less.
BLOCK_BYTES = 4 << 20
#: Places below this take one byte.
SHORT = 192
#: Words of one task are sorted by so many bytes (one number).
FIRST_BYTES = 8


def dump(x, squeeze: bool = True) -> bytes:
    data = pickle.dumps(x, protocol=5)
    return zlib.compress(data, 1) if squeeze else data


def load(b: bytes):
    return pickle.loads(b if b[:1] == b"\x80" else zlib.decompress(b))


def numbering() -> dict:
    """Gives each new key the next number, from 0."""
    return defaultdict(itertools.count().__next__)


def narrow(a: np.ndarray) -> np.ndarray:
    """As few bytes as hold the numbers."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.int64)


def join_words(words: list):
    """Words as one string, if none has the sign that parts them."""
    if words:
        sign = b"\0" if isinstance(words[0], bytes) else "\0"
        one = sign.join(words)
        if one.count(sign) == len(words) - 1:
            return one
    return words


def part_words(x) -> list:
    return x if isinstance(x, list) else x.split(b"\0" if isinstance(x, bytes) else "\0")


def put_places(a: np.ndarray) -> tuple:
    """Places as bytes: one for the most frequent words, else the first of three, the others apart."""
    if len(a) and int(a.max()) - SHORT >= 64 << 16:  # more words than fit: one very long text
        return (a,)
    long = a >= SHORT
    rest = a[long] - SHORT
    first = a.astype(np.uint8)
    first[long] = SHORT + (rest >> 16)
    return first, rest.astype(np.uint8), (rest >> 8).astype(np.uint8)


def get_places(x: tuple) -> np.ndarray:
    if len(x) == 1:
        return x[0]
    first, low, middle = x
    a = first.astype(np.uint32)
    long = a >= SHORT
    a[long] = ((a[long] - SHORT) << 16 | middle.astype(np.uint32) << 8 | low) + SHORT
    return a


def open_block(data: bytes) -> tuple:
    """(kept columns, words, places, number of words of each row)."""
    columns, words, places, lens = load(data)
    return columns, part_words(words), get_places(places), lens


def homes(words: list, q: int) -> tuple[list[int], list[np.ndarray]]:
    """The tasks that the words' hashes name, and for each its words' numbers, in the order of the words' first bytes (so that they compress)."""
    coded = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in words]
    home = np.fromiter(map(zlib.crc32, coded), np.int64, len(coded)) % q
    order = np.lexsort((np.array(coded, f"S{FIRST_BYTES}").view(">u8").astype(np.uint64), narrow(home)))
    ends = np.searchsorted(home[order], np.arange(q + 1))
    parts = [i for i in range(q) if ends[i] < ends[i + 1]]
    return parts, [order[ends[i] : ends[i + 1]] for i in parts]


def block_key(part: int, k: int) -> int:
    return part << 32 | k


def pack(df: DataFrame, text: str, keep: list[str], split: Callable[[str], list] | None = None, index: Callable[[list[str]], tuple] | None = None) -> DataFrame:
    """(block, payload), one row a block; open_block() reads a payload. Words are in the order of their frequency.
    split gives the words of a text (null: empty); or index, of all texts of a block at
    once, the distinct words, the places of all words, and the number of words of each text."""
    small_batches(df.sparkSession)
    n = len(keep)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        rows, texts, ids, places, size = [], [], numbering(), [], 0

        def out():
            words, every, lens = index(texts) if index else (list(ids), np.concatenate(places), np.array([len(a) for a in places], np.int64))
            order = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words))
            data = dump(([list(c) for c in zip(*rows)] or [[]] * n, join_words([words[i] for i in order.tolist()]), put_places(rank[every] if len(words) else every), narrow(lens)))
            return pa.RecordBatch.from_arrays([pa.array([block_key(part, k)], pa.int64()), pa.array([data], pa.binary())], ["block", "payload"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(n)]
            for i, x in enumerate(batch.column(n)):
                t = x.as_py() or ""
                rows.append([c[i] for c in columns])
                if index:
                    texts.append(t)
                else:  # words are numbered as they come, and no text is kept
                    words = split(t)
                    places.append(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)))
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield out()
                    k += 1
                    rows, texts, ids, places, size = [], [], numbering(), [], 0
        if rows:
            yield out()

    packed = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, "block long, payload binary")
    return packed.repartition(partitions(df), "block")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup_words(packed: DataFrame, gather: Callable, answer: Callable, total: Callable | None = None, finish: Callable | None = None, schema=None) -> DataFrame:
    """(block, payload, answers): for each block the answers to its words, in their order; or what finish(payload, answers)
    makes of each block, an Arrow table of the schema, in the task where the two meet.

    gather(payload) gives a value for each word of a block (or None for all); in the word's task all of
    them are put together: answer(words, sums) gets the distinct words of the partition and the sums of their values, and
    returns an array of numbers or a list of bytes, one a word. total(words, sums), if given, is what a task
    knows of all its words: it comes as answers of a row without payload."""
    q = 4 * partitions(packed)

    def ask(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                payload = open_block(data.as_py())
                words, values = payload[1], gather(payload)
                parts, own = homes(words, q)
                body = [dump((join_words([words[i] for i in o.tolist()]), None if values is None else narrow(values[o]))) for o in own]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([key] * len(parts), pa.int64()), pa.array(body, pa.binary())], ["part", "block", "words"])

    def reply(batches):
        ids, sums, asked = numbering(), [], []
        for batch in batches:
            for part, key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words, values = load(data.as_py())
                words = part_words(words)
                at = narrow(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                asked.append((part, key, at))
                if values is not None:
                    sums.append((at, values))
        if not asked:
            return
        summed = None
        if sums:
            summed = np.zeros(len(ids), np.int64)
            for at, values in sums:
                summed[at] += values  # a word comes once in a block
        words = list(ids)
        answers = answer(words, summed)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - TaskContext.get().partitionId()], pa.int64()), pa.array([0], pa.int32()), pa.array([dump(total(words, summed))], pa.binary())], ["block", "part", "answers"])
        for part, key, at in asked:
            if isinstance(answers, np.ndarray):
                got = narrow(answers[at])
            else:
                got = [answers[i] for i in at]
                got = (narrow(np.fromiter(map(len, got), np.int64, len(got))), b"".join(got))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([part], pa.int32()), pa.array([dump(got)], pa.binary())], ["block", "part", "answers"])

    asks = packed.mapInArrow(ask, "part int, block long, words binary").repartition(q, "part")
    replies = asks.mapInArrow(reply, "block long, part int, answers binary")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return pa.table({"block": right.column("block"), "payload": pa.nulls(right.num_rows, pa.binary()), "answers": right.column("answers")})
        data = left.column("payload")[0].as_py()
        words = part_words(load(data)[1])
        got = dict(zip(right.column("part").to_pylist(), right.column("answers")))
        out = None
        for part, own in zip(*homes(words, q)):
            x = load(got[part].as_py())
            if isinstance(x, np.ndarray):
                out = np.zeros(len(words), np.int64) if out is None else out
                out[own] = x
            else:
                out = [None] * len(words) if out is None else out
                cuts = np.concatenate(([0], np.cumsum(x[0], dtype=np.int64))).tolist()
                for i, a, b in zip(own.tolist(), cuts, cuts[1:]):
                    out[i] = x[1][a:b]
        out = [] if out is None else narrow(out) if isinstance(out, np.ndarray) else out
        if finish:
            return finish(data, out)
        return pa.table({"block": left.column("block"), "payload": left.column("payload"), "answers": pa.array([dump(out, False)], pa.binary())})

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(meet, schema or "block long, payload binary, answers binary")
