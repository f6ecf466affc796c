"""Near-duplicate classes: ProbMinHash signatures, bands, exact verification, connected components.

A text's weighted set has its shingles of SHINGLE words with their counts (a text of fewer words is one
shingle). Each shingle is a Poisson process whose rate is its weight; its arrivals go to random registers, a register
keeps the shingle that arrives first, and a shingle stops when its next arrival is later than all registers. Two
signatures agree in a register with the probability Jaccard similarity J_P of the sets, which is the plain
Jaccard similarity where all counts are 1. Texts that agree in a band of registers are candidates; a pair is
linked if J_P, computed from both sets, is at least THRESHOLD. Classes are connected components of links, with all exact copies.

Candidates without all pairs of a bucket: each bucket has a centre, the text whose buckets hold the most texts (in a group of near copies
that is as a rule their original), and each text is compared with the best of its buckets' centres only. Buckets that then still
hold several components are finished exactly, by a join on rare shingles: of each text's shingles, rarest first, those with
at most 1 - THRESHOLD of its weight before them. Of two texts of different components that share one, those are compared whose places and
parity bitmaps (a bit for each of MARKS cells, whether the text has an odd number of shingles there) allow THRESHOLD; see _possible. So a
link that is left out lies within a component, or is between texts that share none of the BANDS buckets.

Cases: null texts are classes of their own; equal texts, empty ones too, are one class; texts without words are near
nothing else; repeated rows are copies; null or repeated ids are allowed: class_id, a class's smallest id that isn't null, may then
be that of several classes or null, but class_key (a text's hash) is one for each class; an empty table gives an empty result. Very
long texts are taken whole, one at a time. classes() returns its own columns only, whatever others the input has; distinct_documents()
returns the input's columns, and of rows that have id and text in common that with the smallest hash of all its columns.
Plan: signatures are written once; buckets are counted by partial sums and joined (Spark splits skewed buckets); only texts
in shared buckets are read again for their shingles. Nothing of a group is gathered in one task; the classes of texts with a
thousandth of all rows or more go to all executors, so that their rows needn't meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, cut, small_batches, with_hot

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Cells of a parity bitmap, 64 to a word.
MARKS = 512
#: Cells (a power of 2, split in PARTS) in which shingles are counted for the order of the rare-shingle join, and parts of that table.
CELL_BITS, PARTS = 20, 64
#: Where a shingle lies at most in one of two texts that are linked by it (its share of the weight before it); in the other 1 - THRESHOLD.
NEAR_PLACE = (1 - THRESHOLD) / (1 + THRESHOLD)
#: Bytes of text that numpy works on at once, or one text.
SLICE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each number over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array):
    """The bytes and bounds of some texts at a time."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        b = min(b, a + 60_000, len(texts))
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the text it is in. From sums of powers, so that a word's hash is a difference of two."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(data) - 1, _BASE))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)))
    back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(data) - 1, _INVERSE))))
    return mix((sums[last] - sums[first]) * back[first]), np.searchsorted(bounds, first, "right") - 1


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text, hash (48 bits) and count, in the order of text and hash."""
    words, of = word_hashes(data, bounds)
    n = np.bincount(of, minlength=len(bounds) - 1)
    mult = [np.uint64(pow(0x2545F4914F6CDD1D, i + 1, 1 << 64)) for i in range(SHINGLE)]
    h, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= SHINGLE:
        h = sum(words[i : len(words) - SHINGLE + 1 + i] * mult[i] for i in range(SHINGLE))
        same = of[: len(words) - SHINGLE + 1] == of[SHINGLE - 1 :]
        h, own = h[same], of[: len(words) - SHINGLE + 1][same]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        at = np.cumsum(n) - n
        more = [sum((words[at[d] + i] * mult[i] for i in range(n[d])), np.uint64(n[d])) for d in short]
        h, own = np.concatenate((h, np.array(more, np.uint64))), np.concatenate((own, short))
    if not len(h):
        return own, h, h.astype(np.int64)
    key = np.sort((own.astype(np.uint64) << np.uint64(48)) | (mix(h) >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), counts


def signatures(own: np.ndarray, h: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash of n sets: for each register the hash of the element that arrives first (0 in empty sets)."""
    best = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    size = np.bincount(own, minlength=n)
    alone = size[own] == 1
    for d, x in zip(own[alone], h[alone]):  # the only element wins everywhere
        winner[d * REGISTERS : (d + 1) * REGISTERS] = x
    own, h, weights = own[~alone], h[~alone], weights[~alone].astype(np.float64)
    time, turn = np.zeros(len(h)), 0
    with np.errstate(over="ignore"):
        while len(h):
            turn += 1
            r = mix(h * _GOLD + np.uint64(turn) * np.uint64(0xD1B54A32D192ED03))
            register = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
            time = time - np.log(((mix(r + _GOLD) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weights
            at = own * REGISTERS + register
            np.minimum.at(best, at, time)
            won = best[at] == time
            winner[at[won]] = h[won]
            late = best.reshape(n, REGISTERS).max(1)
            go = time < late[own]  # the others' next arrivals come too late for every register
            own, h, weights, time = own[go], h[go], weights[go], time[go]
    return winner.reshape(n, REGISTERS)


def bands_of(texts: pa.Array) -> pa.Array:
    """For each text a hash for each band; none for texts without words."""
    out, lens = [], []
    with np.errstate(over="ignore"):
        for data, bounds in slices(texts):
            n = len(bounds) - 1
            own, h, counts = shingles(data, bounds)
            sig = signatures(own, h, counts, n).reshape(n, BANDS, ROWS)
            mult = np.array([pow(0x2545F4914F6CDD1D, i + 1, 1 << 64) for i in range(ROWS)], np.uint64)
            band = mix((sig * mult).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD).view(np.int64)
            some = np.bincount(own, minlength=n) > 0
            out.append(band[some].ravel())
            lens.append(some * BANDS)
    ends = np.concatenate(([0], np.cumsum(np.concatenate(lens)))) if lens else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))


def sets_of(texts: pa.Array) -> pa.Array:
    """Each text's shingles as bytes: their number, hashes in order, counts."""
    out = []
    with np.errstate(over="ignore"):
        for data, bounds in slices(texts):
            own, h, counts = shingles(data, bounds)
            cuts = np.searchsorted(own, np.arange(len(bounds)))
            for a, b in zip(cuts, cuts[1:]):
                own_counts = counts[a:b]
                flat = b"" if (own_counts == 1).all() else np.minimum(own_counts, 0xFFFFFFFF).astype(np.uint32).tobytes()
                out.append(np.uint32(b - a).tobytes() + np.sort((h[a:b] >> np.uint64(8)).astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + flat)
    return pa.array(out, pa.binary())


def _set(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(b, np.uint32, 1)[0])
    h = np.zeros((n, 8), np.uint8)
    h[:, :5] = np.frombuffer(b, np.uint8, 5 * n, 4).reshape(n, 5)
    rest = b[4 + 5 * n :]
    return h.view(np.uint64).ravel(), np.frombuffer(rest, np.uint32).astype(np.float64) if rest else np.ones(n)


def similarity(a: bytes, b: bytes) -> float:
    """J_P of two sets: the sum over common d of 1 / sum over all e of max(A(e) / A(d), B(e) / B(d))."""
    (x, v), (y, w) = _set(a), _set(b)
    if not len(x) or not len(y):
        return 0.0
    every = np.concatenate((x, y))
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.concatenate(([True], every[1:] != every[:-1]))
    at = np.cumsum(first) - 1
    p, q = np.zeros(at[-1] + 1), np.zeros(at[-1] + 1)
    p[at[np.argsort(order)[: len(x)]]] = v
    q[at[np.argsort(order)[len(x) :]]] = w
    common = (p > 0) & (q > 0)
    ratios, k = np.unique(q[common] / p[common], return_inverse=True)
    whole = np.array([np.maximum(p, q / r).sum() for r in ratios])
    return float((p[common] / whole[k]).sum()) if common.any() else 0.0


def _cells(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefix(b: bytes, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles, rarest first by the counts in seen, that have at most 1 - THRESHOLD of its weight before them; and that weight.
    Those that no other set can have, as they are alone in their cell, are left out."""
    h, w = _set(b)
    if not len(h):
        return h.astype(np.int64), w
    count = seen[_cells(h)]
    order = np.lexsort((h, count))
    before = np.cumsum(w[order]) - w[order]
    n = int(np.searchsorted(before, (1 - THRESHOLD + 1e-6) * w.sum(), "right"))
    a = int(np.searchsorted(count[order[:n]], 2))
    return h[order[a:n]].astype(np.int64), before[a:n] / w.sum()


def marks(b: bytes) -> np.ndarray:
    """A set's parity bitmap. Each shingle that only one of two sets has changes one bit, so that at least as many are in only one
    of them as bits differ."""
    with np.errstate(over="ignore"):
        cell = (mix(_set(b)[0] * _GOLD) % np.uint64(MARKS)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=MARKS) & 1).astype(np.uint8)).view(np.int64)


def _counts(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle in each cell: partial tables of each task, summed by part."""

    def count(batches):
        table = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for b in batch.column(0):
                np.add.at(table, _cells(_set(b.as_py())[0]), 1)
        for i, part in enumerate(np.split(table, PARTS)):
            if part.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])

    def add(batches):
        table = np.zeros((PARTS, (1 << CELL_BITS) // PARTS), np.int64)
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                table[i] += np.frombuffer(b.as_py(), np.int64)
        for i in np.flatnonzero(table.any(1)):
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([np.minimum(table[i], 0x7FFFFFFF).astype(np.int32).tobytes()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    out = np.zeros((PARTS, (1 << CELL_BITS) // PARTS), np.int32)
    for r in sets.select("set").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():
        out[r.part] = np.frombuffer(bytes(r.counts), np.int32)
    return out.ravel()


def _possible() -> F.Column:
    """Whether J_P of the rows a and b can reach THRESHOLD. Of a text's weight at least the share p before the first common shingle is not
    common; and at least the shingles that the bitmaps show, each of weight 1 or more: if d bits differ and the texts have m and n
    shingles, at least (d + m - n) / 2 are only in the first. With the common shares c and d of two texts, J_P <= 1 / (1 / c + 1 / d - 1): a
    term of J_P is at most 1 / (1 / a + (1 - d) / b) for the shares a and b of its shingle, which is concave, so the terms together
    are at most that of the sums."""
    differ = sum((F.bit_count(F.col("a.marks")[i].bitwiseXOR(F.col("b.marks")[i])) for i in range(1, MARKS // 64)), F.bit_count(F.col("a.marks")[0].bitwiseXOR(F.col("b.marks")[0])))

    def common(x, y):
        only = (differ + F.col(f"{x}.n") - F.col(f"{y}.n")) / 2
        return F.greatest(F.lit(1e-9), 1 - F.greatest(F.col(f"{x}.p"), only / F.col(f"{x}.weight")))

    near = 1 / (1 - F.col("a.p")) + 1 / (1 - F.col("b.p")) <= 1 + 1 / THRESHOLD + 1e-5
    return near & (1 / common("a", "b") + 1 / common("b", "a") <= 1 + 1 / THRESHOLD + 1e-5)


def _left_over(sets: DataFrame, buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components that may be linked, of texts in buckets that hold several components. Texts of the
    component that has most rows of a shingle meet only those of others, so that a large component isn't paired with itself."""
    named = buckets.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    # buckets of two, too: each of their texts may have been compared with a centre of another bucket
    mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    left = cut(named.join(mixed.select("band"), "band", "left_semi").select("key", "label").distinct().join(sets, "key"))
    if left.isEmpty():
        return left.select(F.col("key").alias("a"), F.col("key").alias("b"))
    seen = left.sparkSession.sparkContext.broadcast(_counts(left))

    @F.arrow_udf("struct<rare: array<struct<e: bigint, p: double>>, marks: array<bigint>, n: int, weight: double>")
    def first(batch: pa.Array) -> pa.Array:
        whole = [b.as_py() for b in batch]
        found = [prefix(b, seen.value) for b in whole]
        ends = np.concatenate(([0], np.cumsum([len(e) for e, _ in found]))).astype(np.int32)
        e = pa.array(np.concatenate([np.zeros(0, np.int64), *[e for e, _ in found]]))
        p = pa.array(np.concatenate([np.zeros(0), *[p for _, p in found]]))
        rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([e, p], ["e", "p"]))
        size = [_set(b) for b in whole]
        columns = [rare, pa.array([marks(b) for b in whole], pa.list_(pa.int64())), pa.array([len(h) for h, _ in size], pa.int32()), pa.array([float(w.sum()) for _, w in size])]
        return pa.StructArray.from_arrays(columns, ["rare", "marks", "n", "weight"])

    rows = cut(left.select("key", "label", first("set").alias("x")).select("key", "label", F.explode("x.rare").alias("r"), "x.marks", "x.n", "x.weight").select("key", "label", "r.e", "r.p", "marks", "n", "weight"))
    groups = rows.groupBy("e", "label").agg(F.count(F.lit(1)).alias("k"), F.min("p").alias("p"))
    shared = groups.groupBy("e").agg(F.max(F.struct("k", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("kinds"), F.min("p").alias("least")).where((F.col("kinds") > 1) & (F.col("least") <= NEAR_PLACE + 1e-5)).select("e", "main")
    rows = cut(rows.join(shared, "e"))
    a, b = rows.where("label <> main").alias("a"), rows.alias("b")
    once = (F.col("b.label") == F.col("b.main")) | (F.col("a.key") < F.col("b.key"))
    pairs = a.join(b, (F.col("a.e") == F.col("b.e")) & (F.col("a.label") != F.col("b.label")) & once & _possible())
    return pairs.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(key, label) of linked keys: the smallest key of each component. In each step a key takes the smallest of its label, its
    neighbours' labels and its label's label, until nothing changes."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("m"))
        up = labels.select(F.col("key").alias("label"), F.col("label").alias("top"))
        step = labels.join(up, "label").join(near, "key").select("key", F.least("label", "m", "top").alias("label"), F.col("label").alias("old"))
        step = cut(step)
        labels = step.select("key", "label")
        if step.where("label <> old").isEmpty():
            return labels


def _classified(df: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and of every text key, rep (its smallest id, null last), n (rows), class_id, class_size, class_key and
    best (whether it is that of the class's smallest id)."""
    small_batches(df.sparkSession)
    bands = F.arrow_udf(bands_of, "array<bigint>")
    rows = df.select(F.col(f"`{id}`").alias("doc_id"), F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("key"), bands(F.col(f"`{text}`")).alias("bands"))
    rows = cut(rows)
    nodes = cut(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")))
    one = nodes.select("key", F.explode("bands").alias("band"))
    shared = one.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    buckets = cut(one.join(shared, "band").select("band", "key", "k"))
    labels = _linked(df, id, text, nodes, buckets)

    named = nodes.select("key", "rep", "n").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key"))["key"]
    by_label = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"), first.alias("first"))
    by_key = named.join(by_label, "label").select("key", "rep", "n", "class_id", "class_size", F.col("label").alias("class_key"), (F.col("key") == F.col("first")).alias("best"))
    return rows, cut(by_key)


def classes(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (md5 of the text), class_id, class_size (rows), class_key (null for null texts) of every row."""
    rows, by_key = _classified(df, id, text)
    out = with_hot(rows.select("doc_id", "key"), by_key.select("key", "n", "class_id", "class_size", "class_key"), "key", "n")
    return out.select("doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "class_key")


def _linked(df: DataFrame, id: str, text: str, nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    spark = df.sparkSession
    wanted = cut(buckets.select("key").distinct().join(nodes.select("key", "rep"), "key"))
    n = wanted.count()
    empty = spark.createDataFrame([], "key binary, label binary")
    if not n:
        return empty
    # the shingles of one text for each key, read again
    texts = df.select(F.col(f"`{id}`").alias("rep0"), F.col(f"`{text}`").alias("text")).withColumn("key0", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = texts.join(_few(wanted, n), F.col("rep0").eqNullSafe(F.col("rep")) & (F.col("key0") == F.col("key")), "inner")
    sets = cut(texts.select("key", F.arrow_udf(sets_of, "binary")(F.col("text")).alias("set")))
    sets = sets.groupBy("key").agg(F.first("set").alias("set")) if sets.count() > n else sets
    like = F.arrow_udf(lambda a, b: pa.array([similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64()), "double")

    def compare(edges: DataFrame) -> DataFrame:
        """Those of the pairs a, b that are linked."""
        edges = cut(edges)
        k = edges.count()
        own = sets
        if 2 * k < n:
            ends = edges.select(F.col("a").alias("key")).union(edges.select(F.col("b").alias("key"))).distinct()
            own = sets.join(_few(ends, 2 * k), "key", "left_semi")
        pairs = _few(edges, k).join(own.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(own.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
        return cut(pairs.withColumn("j", like("x", "y")).where(F.col("j") >= THRESHOLD - 1e-9).select("a", "b"))

    known = buckets.groupBy("key").agg(F.sum("k").alias("known"))
    named = cut(buckets.join(known, "key"))
    centre = named.groupBy("band").agg(F.max(F.struct("known", "key")).alias("c"))
    edges = named.join(centre, "band").groupBy("key").agg(F.max("c").alias("c")).select("key", F.col("c.key").alias("centre"))
    links = compare(edges.where("key <> centre").select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct())
    labels = components(links)
    more = compare(_left_over(sets, buckets, labels))
    if more.isEmpty():
        return labels
    # components of components
    of = labels.select("key", "label")
    for end in ("a", "b"):
        more = more.join(of.select(F.col("key").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    up = components(more.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    alone = up.join(labels, "key", "left_anti")
    joined = labels.join(up.select(F.col("key").alias("label"), F.col("label").alias("top")), "label", "left")
    return cut(joined.select("key", F.coalesce("top", "label").alias("label")).unionByName(alone))


def distinct_documents(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that with the class's smallest id (null last; null texts are kept): the input's rows and columns.

    The texts that lose rows go to all executors if they are few; else rows with their texts are shuffled by text, hot ones apart."""
    rows, by_key = _classified(df, id, text)
    losing = cut(by_key.where("NOT best OR n > 1").select(F.col("key").alias("__key"), "n", F.struct("best", "rep").alias("__loss")))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    marked = df.select(whole.alias("__row"), F.col(f"`{id}`").alias("__id"), F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("__key"))
    if losing.count() <= BROADCAST_ROWS:
        marked = marked.join(F.broadcast(losing.drop("n")), "__key", "left")
    else:
        marked = with_hot(marked, losing, "__key", "n")
    kept = marked.where(F.col("__loss").isNull() | (F.col("__loss.best") & F.col("__id").eqNullSafe(F.col("__loss.rep"))))
    # equal rows that stand there again
    again = rows.where("key IS NOT NULL").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    again = cut(again.select(F.col("doc_id").alias("__a"), F.col("key").alias("__b")))
    if not again.isEmpty():
        same = F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__key") == F.col("__b"))
        once = kept.join(again, same, "left_semi").groupBy("__id", "__key").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
        kept = kept.join(again, same, "left_anti").select("__row").union(once.select("__row"))
    return kept.select("__row.*")
