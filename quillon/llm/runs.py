"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are the same) of at least REPEATS * q words and at least SHORTEST, that
can't be made longer with that period. For each power of two F the dictionary names every stretch of F words (a factor) by the names of its
two halves, so that equal factors have equal names, and keeps for each place the next place with the same factor. Within a run of
period q, F / 2 < q <= F, the next occurrence of a factor is q words on, as a nearer one would give the run a smaller period; its
occurrences i, i + q, i + 2q, ... are an arithmetic progression, and neighbouring places have the same step. So each level proposes the steps in
(F / 2, F], and neighbouring places of one step, enough of them for REPEATS periods, are a run, whose ends are where the names stop
to agree. A run's period belongs to one level only; runs are extended word by word at their ends and kept once. Factors that come once in
their text take no part in longer ones, as all factors of a run come twice.

Cases: a null text has no words, no run and an empty collapsed text; so have empty ones. Very long texts are taken whole: work grows with the
words times the levels that still have repeated factors, and memory is about 150 bytes a word of the longest text or of a batch. Of runs with
equal exponents the one that starts first, then the one of the smaller period, is the best. Repeated rows give repeated results; an empty
table gives an empty one; other columns are kept, unless an added column has their name.
Plan: a map over Arrow batches without a shuffle; no task needs another's rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import small_batches

SHORTEST, REPEATS = 6, 4

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())])
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def words_of(texts: pa.Array) -> list[list[bytes]]:
    """The words of each text; bytes.split() parts at these six characters: space, \\t, \\n, \\v, \\f, \\r."""
    return [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]


def named(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word, the same for the same word, of all texts in a row."""
    vocabulary = defaultdict(itertools.count().__next__)
    return np.fromiter(map(vocabulary.__getitem__, itertools.chain.from_iterable(texts)), np.int64, sum(map(len, texts)))


def _progressions(pos: np.ndarray, step: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches that neighbouring places of one step in (size / 2, size] show."""
    near = np.flatnonzero((step <= size) & (2 * step > size))
    if not len(near):
        return []
    p, d = pos[near], step[near]
    first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]))))
    count = np.diff(np.append(first, len(p)))
    start, period = p[first], d[first]
    length = count - 1 + period + size
    good = (length >= REPEATS * period) & (length >= SHORTEST)
    return list(zip(start[good].tolist(), length[good].tolist(), period[good].tolist()))


def runs_of(names: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts that stand in a row; text k has the words names[bounds[k] : bounds[k + 1]]."""
    n = len(names)
    if n < SHORTEST:
        return []
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pos, size = np.arange(n), 1
    key = own * (int(names.max()) + 1) + names
    found: set[tuple[int, int, int]] = set()
    while len(pos):
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        step = np.full(len(pos), n)
        step[order[:-1][same]] = pos[order[1:][same]] - pos[order[:-1][same]]
        for start, length, period in _progressions(pos, step, size):
            found.add(_extended(names, bounds, start, length, period))
        # the names of this level's factors, -1 where a factor comes once
        twice = np.zeros(len(pos), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        name = np.full(n + 1, -1)
        name[pos[order]] = np.concatenate(([0], np.cumsum(~same)))
        name[pos[~twice]] = -1
        pos = pos[twice]
        pos = pos[pos + size < n]
        pos = pos[(name[pos + size] >= 0) & (own[pos] == own[np.minimum(pos + size, n - 1)])]
        key = name[pos] * (n + 1) + name[pos + size]
        size *= 2
    return sorted(found)


def _extended(names: np.ndarray, bounds: np.ndarray, start: int, length: int, period: int) -> tuple[int, int, int]:
    k = int(np.searchsorted(bounds, start, "right")) - 1
    end = start + length
    while start > bounds[k] and names[start - 1] == names[start - 1 + period]:
        start -= 1
    while end < bounds[k + 1] and names[end] == names[end - period]:
        end += 1
    return start, end - start, period


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; then the smallest start and period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats: of each run the first period stays."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return b" ".join(words)


def analysed(texts: pa.Array) -> pa.Array:
    """RESULT of each text."""
    words = words_of(texts)
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    of: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for start, length, period in runs_of(named(words), bounds):
        k = int(np.searchsorted(bounds, start, "right")) - 1
        of[k].append((start - int(bounds[k]), length, period))
    as_rows = [[dict(zip(("start", "length", "period"), r)) for r in sorted(rs, key=lambda r: (r[0], r[2]))] for rs in of]
    best = [b and dict(zip(("start", "length", "period"), b)) for b in map(best_of, of)]
    columns = [
        pa.array([len(w) for w in words], pa.int64()),
        pa.array(as_rows, pa.list_(_RUN)),
        pa.array(best, _RUN),
        pa.array([collapsed(w, rs) for w, rs in zip(words, of)], pa.binary()).cast(pa.string()),
    ]
    return pa.StructArray.from_arrays(columns, ["n_words", "runs", "best", "collapsed"])


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, runs (array of start, length, period, by start and period), best (one of them, or null) and collapsed (the words that stay)."""
    small_batches(df.sparkSession)
    added = RESULT.fieldNames()
    keep = [c for c in df.columns if c not in added]
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.arrow_udf(analysed, RESULT)(F.col(f"`{text}`")).alias("__runs"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__runs.{c}").alias(c) for c in added])


def repeated(words: list[bytes], h: int) -> list[bytes]:
    """From word a = g % n on, g being h / 10, each word is one of the p = 1 + (n - a) / (3 + g % 8) words from a on, in turn."""
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def with_repeats(df: DataFrame, chosen: str, text: str = "text") -> DataFrame:
    """The same rows; where the column chosen has a number that 10 divides (null: not), the words of a text with words repeat themselves."""
    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def of(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = texts.cast(pa.binary()).to_pylist()
        for k, h in enumerate(numbers.to_pylist()):
            if h is not None and h % 10 == 0 and out[k] and (words := out[k].split()):
                out[k] = b" ".join(repeated(words, h))
        return pa.array(out, pa.binary()).cast(pa.string())

    return df.withColumn(text, of(F.col(f"`{text}`"), F.col(f"`{chosen}`").cast("long")))
