"""Document fingerprints by winnowing.

Every run of GRAM code points has a hash; of each WINDOW neighbouring hashes the smallest is kept, the rightmost of equal
ones, with its place. Two texts that share GRAM + WINDOW - 1 code points (27) share a kept hash. A text shorter
than GRAM is one gram; one with fewer than WINDOW grams has one window; an empty text keeps nothing.

The likeness of two fingerprints is the Jaccard similarity of their sets of hashes (1 for two empty sets).

Cases: a null text counts as empty; equal texts have equal fingerprints, so repeated rows agree; a very long text is read
whole, in pieces that overlap; other columns are not returned; an empty table gives an empty result. Next documents: ids descend, nulls come last, equal ids by descending text; the document
after the last is the first.
Plan for next documents: ids are cut into ranges at quantiles; each range's first row goes also to
the range before it (as a guest), so that one shuffle by range and a sort within it brings every row next to its successor.
A task streams over its ranges and holds two rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import BATCH_BYTES, small_batches

GRAM, WINDOW = 12, 16
#: A hash has so many bits; below them stands the place, in pieces of a text so long.
HASH_BITS, PLACE_BITS = 40, 24
_PLACES = np.uint64((1 << PLACE_BITS) - 1)
_BASE = 0x5851F42D4C957F2D


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM codes (of all, if they are fewer), from runs of twice the length each time."""
    n = min(GRAM, len(codes))
    h, size, out, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    rest = n
    while rest:
        if rest & 1:
            out = h if out is None else out[: len(codes) - done - size + 1] * power(size) + h[done : done + len(codes) - done - size + 1]
            done += size
        rest >>= 1
        if rest:
            h = h[:-size] * power(size) + h[size:]
            size *= 2
    out = out[: len(codes) - n + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def _lowest(key: np.ndarray, window: int) -> np.ndarray:
    """The smallest of each window neighbours."""
    low, size = key, 1
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(key) - window + 1], low[window - size : window - size + len(key) - window + 1])


def winnow(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their places, by place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, places, step = [], [], (1 << PLACE_BITS) - GRAM - WINDOW
    for a in range(0, max(1, len(codes) - GRAM - WINDOW + 2), step):
        part = codes[a : a + step + GRAM + WINDOW - 2]
        if not len(part):
            break
        h = gram_hashes(part) & ~_PLACES
        key = h | (_PLACES - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost is smallest
        low = _lowest(key, min(WINDOW, len(h)))
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        hashes.append(low >> np.uint64(PLACE_BITS))
        places.append((_PLACES - (low & _PLACES)).astype(np.int64) + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, p = np.concatenate(hashes), np.concatenate(places)
    new = np.concatenate(([True], p[1:] != p[:-1]))
    return h[new], p[new]


def shown(kept: tuple[np.ndarray, np.ndarray]) -> str:
    """hash@place in hex and decimal, comma-joined."""
    return ",".join([f"{h:x}@{p}" for h, p in zip(kept[0].tolist(), kept[1].tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """Add an array of (hash, place) of each text."""

    @F.arrow_udf("array<struct<hash: bigint, place: bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            found = [winnow(x.as_py() or "") for x in texts]
        ends = np.concatenate(([0], np.cumsum([len(h) for h, _ in found]))).astype(np.int32)
        h = np.concatenate([x[0] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        p = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h), pa.array(p)], names=["hash", "place"]))

    return df.withColumn(to, of(F.col(text)))


def with_next(df: DataFrame, id: str, text: str, ranges: int) -> DataFrame:
    """ids may be numbers, texts, dates or of any other type with an order. id, text, range and guest of every row, guests included, dealt by range and sorted: successors follow each other."""
    rows = df.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    if ranges < 2:
        cuts = []
    elif isinstance(kind, T.NumericType):
        probs = [i / ranges for i in range(1, ranges)]
        cuts = rows.select(F.percentile_approx("id", probs, 10_000).alias("c")).first().c
    else:  # the ids alone, dealt by Spark's own ranges: the first id of each
        dealt = rows.select("id").where("id IS NOT NULL").repartitionByRange(ranges, F.col("id"))
        cuts = [r.c for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("c")).collect()]
    cuts = sorted(set(cuts or []), reverse=True)
    # range 0 has the largest ids; null ids are in the last
    place = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]).cast(T.ArrayType(kind)), lambda c: c >= F.col("id")))
    place = F.when(F.col("id").isNull(), len(cuts)).otherwise(place)
    heads = {r.range: r.head for r in rows.select(place.alias("range"), "id").groupBy("range").agg(F.max("id").alias("head")).collect()}  # a row for each range
    first = sorted(heads)
    before = {heads[r]: first[k - 1] for k, r in enumerate(first)}  # the head of each range is a guest in the one before, of the first in the last
    guest = F.lit(None).cast("int")
    for head, r in before.items():
        guest = F.when(F.col("id").eqNullSafe(F.lit(head)), r).otherwise(guest)
    if len(before) > 200:  # too many for a chain of conditions
        known = F.create_map(*[F.lit(x) for h, r in before.items() if h is not None for x in (h, r)])
        guest = F.when(F.col("id").isNull(), before.get(None)).otherwise(known[F.col("id")])
    rows = rows.withColumn("range", place).withColumn("guest", F.lit(False))
    visits = rows.withColumn("range", guest.cast("int")).where("range IS NOT NULL").withColumn("guest", F.lit(True))
    return rows.union(visits).repartition(ranges, "range").sortWithinPartitions("range", "guest", F.col("id").desc_nulls_last(), F.col("text").desc())


def compare_edits(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    small_batches(df.sparkSession)
    id_type = df.schema[id].dataType
    ranges = max(1, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = with_next(df, id, text, ranges)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [id_type, T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(k) for k in kinds]

    def run(batches):
        held, done, size = None, [], 0  # a row that waits for its successor; results and their characters

        def result(row, following):
            nonlocal size
            old = winnow(row[1]) if row[3] is None else row[3]
            nxt = winnow(following[1])
            new_text = edited(row[1], following[1])
            new = winnow(new_text)
            prints = shown(old), shown(new)
            size += len(prints[0]) + len(prints[1])
            done.append((row[0], len(row[1]), hashlib.sha256(new_text.encode("utf-8", "surrogatepass")).hexdigest(), *prints, likeness(old[0], new[0]), likeness(old[0], nxt[0])))
            return nxt

        def out():
            nonlocal size
            size = 0
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
            done.clear()
            return batch

        with np.errstate(over="ignore"):
            for batch in batches:
                ids, ranges, guests = (batch.column(i).to_pylist() for i in (0, 2, 3))
                for i, t in enumerate(batch.column(1)):
                    row = [ids[i], t.as_py(), ranges[i], None]
                    if held is not None and held[2] == row[2]:
                        row[3] = result(held, row)
                        held = None
                    held = None if guests[i] else row
                    if len(done) >= 500 or size >= BATCH_BYTES:
                        yield out()
            if done:
                yield out()

    return rows.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
