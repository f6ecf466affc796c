"""Pairs of similar vectors and their clusters, exactly.

Unit vectors with cosine >= t lie within sqrt(2 - 2 t) of each other, and so do their projections on any unit directions. Vectors are dealt by range
over the cells of a grid on the directions in which all vectors vary most, and kept in packs of at most CHUNK, each with its box in those directions. Two
packs whose boxes are no farther apart than that distance are one block, multiplied in numpy by tiles with boxes of their own. A vector is shuffled and
kept once: blocks are made by a cartesian product that reads the packs' files again, not by copies of them. Products grow with the square of vectors
that lie close together, memory does not, and the disk grows with the vectors. Clusters need no list of all pairs: each block gives a forest of its pairs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions.arrays import let, mean
from quillon.operators import written
from quillon.operators.ranking import global_rank
from quillon.operators.written import kept

DIRECTIONS, CHUNK = 8, 32_768
#: Vectors of both sides that are multiplied at once, the similar pairs that go on at once, and the vectors of a box on the second side.
TILE, HITS, LEAF = (1024, 8192), 200_000, 256


def centred_unit(x: Column) -> Column:
    """The vector less its mean, at length 1 (zeros stay)."""
    centred = lambda x: let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    unit = lambda c: let(F.sqrt(dot(c, c)), lambda n: F.transform(c, lambda v: F.when(n > 0, v / n).otherwise(0.0)))
    return let(x, lambda x: let(centred(x), unit))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def directions(rows: DataFrame, v: str, dims: int) -> np.ndarray:
    """Unit directions in which the vectors vary most: eigenvectors of their covariance, which has dims x dims numbers."""

    def sums(batches):
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = np.concatenate((x, np.ones((len(x), 1))), 1)
            total += x.T @ x
        i, j = np.divmod(np.arange(total.size), dims + 1)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((dims + 1, dims + 1))
    for r in rows.select(v).mapInArrow(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    n = max(total[-1, -1], 1.0)
    mean = total[:-1, -1] / n
    _, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return vectors[:, ::-1][:, :DIRECTIONS].T


def _order(at: np.ndarray) -> np.ndarray:
    """Places in an order in which those that follow each other lie close together: halved across their longest side, down to a LEAF."""
    parts, out = [np.arange(len(at))], []
    while parts:
        part = parts.pop()
        if len(part) <= LEAF:
            out.append(part)
            continue
        half = (len(part) // 2 + LEAF - 1) // LEAF * LEAF  # whole leaves first
        part = part[np.argpartition(at[part, np.ptp(at[part], 0).argmax()], half)]
        parts += [part[half:], part[:half]]
    return np.concatenate(out)


def _packs(df: DataFrame, id: str, unit: str, width: float, dims: int) -> tuple[DataFrame, np.ndarray]:
    """(pack, low, high, ids, v), written: up to CHUNK vectors as compressed doubles, with their box in the directions; and the directions."""
    since = written.marked()
    # written once: the vectors are read for the directions, their ranges and the packs
    rows = kept(df.select(F.col(id).alias("id"), F.col(unit).alias("v"))).where("id IS NOT NULL")
    axes = directions(rows, "v", dims)
    own = to_arrow_type(rows.schema["id"].dataType)
    # ranges are found on a sample and differ in size: a quarter less than a pack each, so that few need a second one
    parts = max(math.ceil(rows.count() / (CHUNK * 0.75)), 1)
    cells = [F.floor(dot(F.col("v"), F.lit(d.tolist())) / width) for d in axes]
    most = CHUNK

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= most:
                yield pack([*held, batch.slice(0, most - n)])
                batch, held, n = batch.slice(most - n), [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield pack(held)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for b in held])
        at = x @ axes.T
        order = _order(at)
        ids = pa.concat_arrays([b.column("id").cast(own) for b in held]).take(pa.array(order))
        return pa.record_batch([pa.array([at.min(0).tolist()]), pa.array([at.max(0).tolist()]), pa.ListArray.from_arrays([0, len(x)], ids), pa.array([zlib.compress(x[order].tobytes(), 1)])], ["low", "high", "ids", "v"])

    dealt = rows.repartitionByRange(parts, *cells, F.xxhash64("id")).select("id", "v")
    id_type = rows.schema["id"].dataType.simpleString()
    packed = dealt.mapInArrow(packs, f"low array<double>, high array<double>, ids array<{id_type}>, v binary")
    packed = kept(packed.select(F.monotonically_increasing_id().alias("pack"), "*"))
    written.drop(since, 1)  # the rows before the packs
    return packed, axes


def _blocks(df: DataFrame, id: str, unit: str, least: float, dims: int) -> tuple[DataFrame, np.ndarray]:
    """(pack, ids, v, pack2, ids2, v2): each two packs that may hold similar vectors once, and each pack with itself; and the directions."""
    width = _width(least)
    packs, axes = _packs(df, id, unit, width, dims)
    other = packs.select(*[F.col(c).alias(c + "2") for c in packs.columns])
    gap = F.zip_with(F.zip_with("low2", "high", lambda x, y: x - y), F.zip_with("low", "high2", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = let(gap, lambda g: dot(g, g)) <= width * width
    # each pair of partitions of files is a task that reads both: a join by keys would write a pack once for each other one that it meets
    pairs = packs.hint("shuffle_replicate_nl").join(other, (F.col("pack") <= F.col("pack2")) & near)
    return pairs.select("pack", "ids", "v", "pack2", "ids2", "v2"), axes


def _width(least: float) -> float:
    """How far apart similar unit vectors may be, with some room for rounding."""
    return math.sqrt(2 - 2 * least) + 1e-6


def _boxes(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest coordinates of each `size` places."""
    starts = np.arange(0, len(at), size)
    return np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)


def _hits(x: np.ndarray, y: np.ndarray, own: bool, least: float, axes: np.ndarray) -> Iterator[tuple]:
    """(k, m, cosine) of the similar pairs of places in x and y, each pair once where both are the same pack, by tiles. Products in single precision tell which pairs
    are worked out in double."""
    width, dims = _width(least), x.shape[1]
    x32, y32, t = x.astype(np.float32), y.astype(np.float32), np.float32(least - (dims + 8) * 2.4e-7)
    (low, high), (low2, high2) = _boxes(x @ axes.T, TILE[0]), _boxes(y @ axes.T, LEAF)
    for tile, at in enumerate(range(0, len(x), TILE[0])):
        gap = np.maximum(np.maximum(low2 - high[tile], low[tile] - high2), 0)
        close = np.repeat((gap * gap).sum(1) <= width * width, LEAF)[: len(y)]
        if own:
            close[:at] = False
        close = np.flatnonzero(close)
        for to in range(0, len(close), TILE[1]):
            cols = close[to : to + TILE[1]]
            k, m = np.nonzero(x32[at : at + TILE[0]] @ y32[cols].T >= t)
            k, m = k + at, cols[m]
            if own:
                k, m = k[m > k], m[m > k]
            for part in range(0, len(k), HITS):
                p, q = k[part : part + HITS], m[part : part + HITS]
                cosine = np.einsum("ij,ij->i", x[p], y[q])
                good = cosine >= least
                if good.any():
                    yield p[good], q[good], cosine[good]


def _pairs_of_packs(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(ids, vectors, ids, vectors, whether both are the same pack) of each block."""
    vectors = lambda v: np.frombuffer(zlib.decompress(v.as_buffer()), np.float64).reshape(-1, dims)
    last, x = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            pack, ids, v, pack2, ids2, v2 = (batch.column(c)[k] for c in ("pack", "ids", "v", "pack2", "ids2", "v2"))
            if last != pack.as_py():  # a task takes a pack's blocks one after the other
                last, x = pack.as_py(), vectors(v)
            own = last == pack2.as_py()
            yield ids.values.to_numpy(zero_copy_only=False), x, ids2.values.to_numpy(zero_copy_only=False), x if own else vectors(v2), own


def similar_pairs(df: DataFrame, id: str, unit: str, least: float, dims: int) -> DataFrame:
    """(a, b, cosine) with a < b of unit vectors with a cosine of at least `least`."""
    id_type = df.schema[id].dataType
    own_type = to_arrow_type(id_type)
    blocks, axes = _blocks(df, id, unit, least, dims)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, ids2, y, own in _pairs_of_packs(batches, dims):
            for k, m, cosine in _hits(x, y, own, least, axes):
                a, b = ids[k], ids2[m]
                first = a < b
                yield pa.record_batch([pa.array(np.where(first, a, b), own_type), pa.array(np.where(first, b, a), own_type), pa.array(cosine)], ["a", "b", "cosine"])

    return blocks.mapInArrow(pairs, f"a {id_type.simpleString()}, b {id_type.simpleString()}, cosine double")


def links(df: DataFrame, id: str, unit: str, least: float, dims: int) -> DataFrame:
    """(a, b): pairs that connect what similar_pairs() connects. Of a block's similar pairs as many go on as join its vectors, fewer than it has vectors."""
    id_type = df.schema[id].dataType
    own_type = to_arrow_type(id_type)
    blocks, axes = _blocks(df, id, unit, least, dims)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, ids2, y, own in _pairs_of_packs(batches, dims):
            shift = 0 if own else len(ids)
            ids = ids if own else np.concatenate((ids, ids2))
            label = np.arange(len(ids))
            for k, m, _ in _hits(x, y, own, least, axes):
                label = joined(label, k, m + shift)
            other = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.record_batch([pa.array(ids[label[other]], own_type), pa.array(ids[other], own_type)], ["a", "b"])

    def joined(label: np.ndarray, k: np.ndarray, m: np.ndarray) -> np.ndarray:
        low, high = np.minimum(label[k], label[m]), np.maximum(label[k], label[m])
        apart = low < high
        if not apart.any():
            return label
        tops = np.arange(len(label)).tolist()

        def top(x: int) -> int:
            while tops[x] != x:
                tops[x] = x = tops[tops[x]]
            return x

        for pair in np.unique(low[apart] * len(label) + high[apart]).tolist():
            p, q = sorted((top(pair // len(label)), top(pair % len(label))))
            tops[q] = p
        return np.array([top(x) for x in range(len(label))])[label]

    return blocks.mapInArrow(forest, f"a {id_type.simpleString()}, b {id_type.simpleString()}")


def similar_clusters(nodes: DataFrame, id: str, unit: str, least: float, dims: int) -> DataFrame:
    """clusters() of the similar pairs. Of equal vectors the one with the smallest id stands for all, so that copies aren't compared."""
    nodes = kept(nodes.select(F.col(id).alias("id"), F.col(unit).alias("v")))
    classes = kept(nodes.groupBy("v").agg(F.min("id").alias("first"), F.collect_list("id").alias("ids")))
    copies = classes.where(F.size("ids") > 1).select(F.col("first").alias("a"), F.explode("ids").alias("b")).where("a <> b")
    return clusters(nodes, "id", links(classes.select("first", "v"), "first", "v", least, dims).union(copies))


def clusters(nodes: DataFrame, id: str, pairs: DataFrame) -> DataFrame:
    """(id, root, cluster): root is the smallest id of the component; cluster numbers components by it, from 0."""
    pairs = kept(pairs.select("a", "b"))  # both directions read them
    both = kept(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    since = written.marked()
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("top"))
        step = kept(labels.join(up, "root").join(near, "id").select("id", F.least("root", "m", "top").alias("root"), F.col("root").alias("old")))
        labels = step.select("id", "root")
        written.drop(since, 1)  # the labels before these
        if step.where("root <> old").isEmpty():
            break
    whole = nodes.select(F.col(id).alias("id")).join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    roots = whole.select("root").distinct()
    numbered = global_rank(roots, F.floor(F.col("root") / 65536), ["root"], "k").select("root", (F.col("k") - 1).alias("cluster"))
    return whole.join(numbered, "root").select("id", "root", "cluster")
