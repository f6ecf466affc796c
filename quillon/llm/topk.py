"""Exact top-k inner products by an impact-ordered index, read score at a time.

Vectors are turned into whole numbers, floor(scale * x). For each dimension a posting list holds all vectors by their value; postings of one
value are a segment, and its impact for a query is the query's number times the value. Segments of all dimensions are processed by
descending impact, level by level; each adds its impact to its vectors' sums. At a level, what a vector hasn't got yet is at most the
level for each dimension still open to it, so its sum and that bound limit its score. The k best of exact scores seen so far give the
score to beat. Processing stops only where the vectors that may still reach it (ties included: a smaller id may win) are few, or where all
positive impacts are processed; these possible members are then scored exactly.

Equal vectors are one entry of the index with their k + 1 smallest ids, as no more of them can be among the k best of any query; equal
queries are searched once. The index is made in shards of about SHARD_ROWS vectors by their hash, queries are put in packs of about PACK_ROWS, the packs in
groups of about GROUP_QUERIES, and each group meets each shard once, by a shuffle: a task holds one shard and one group, and neither the driver nor an executor
holds all queries. A shard's k + 1 best go on, through a window that keeps k + 1 of each task in front of its shuffle.

Cases: vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as filled up with zeros; an empty one has score 0
everywhere. Repeated rows are rows of their own: a query's own row is left out, another with the same id or vector is not. A null id is no
query; as a candidate it comes last among equal scores. Numbers beyond 64 bits stop at their ends (floor() does) and so do scores, which are ranked by
their exact values before. An empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.common import cut, small_batches

K, SCALE = 5, 256
SHARD_ROWS, PACK_ROWS, GROUP_QUERIES = 16_384, 128, 4096
#: Processing stops at a level where at most this share of a shard may be among the best; below a level at which all dimensions together are this share of the
#: score to beat the next level is 0. A dimension's values have a table of segments if they span fewer than MOST_SEGMENTS; else they are searched.
FEW, SMALL, MOST_SEGMENTS = 1 / 256, 1 / 8, 1 << 12
#: What each processed posting adds to its vector's sum, all sums being whole: under 2 ** 12 dimensions stay a fraction.
COUNT = 1 / (1 << 12)
#: Sums of products below this are exact in floats, together with the fraction that counts.
MOST_SUM = 1 << 40
#: The ends of scores, and of what ranks them.
LONG, MOST = (1 << 63) - 1, 10**38 - 1


def numbers(vector: str, scale: int = SCALE) -> tuple[Column, Column]:
    """Whether a vector takes part, and its whole numbers."""
    x = F.col(f"`{vector}`")
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return good, F.transform(x, lambda e: F.floor(e.cast("double") * scale))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A row for each vector, as floats while all sums of products are exact in them, else as Python's numbers."""
    flat, lengths = np.asarray(vectors.flatten(), np.int64), np.asarray(vectors.value_lengths(), np.int64)
    most = max(-int(flat.min(initial=0)), int(flat.max(initial=0)))
    small = width < 1 / COUNT and width * most * most < MOST_SUM
    out = np.zeros((len(vectors), width), np.float64 if small else object)
    first = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(flat)) - np.repeat(first, lengths)] = flat if small else flat.astype(object)
    return out


class Shard:
    """An index of vectors: for each dimension its postings by value, and where the segment of each value begins."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.exact = vectors.dtype == np.float64 and vectors.size > 0
        if self.exact:
            self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
            self.values = np.take_along_axis(vectors.T, self.order, 1)
            self.low, self.span = int(vectors.min()), int(vectors.max() - vectors.min()) + 2
            self.begins = None
            if self.span <= MOST_SEGMENTS:
                every = np.arange(self.low, self.low + self.span)
                self.begins = np.stack([np.searchsorted(x, every) for x in self.values])

    def begin(self, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
        """In each dimension the first posting of at least a value."""
        if self.begins is None:
            return np.array([np.searchsorted(self.values[d], x) for d, x in zip(dims, values)], np.int64)
        return self.begins[dims, np.clip(values - self.low, 0, self.span - 1)]

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows] @ query

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that hold all of the k best (with all ties), their exact scores, and how many postings were processed."""
        n = len(self.vectors)
        every = np.arange(n)
        if not self.exact or query.dtype != np.float64 or n <= k:
            return every, (self.vectors.astype(object) @ query.astype(object)) if n else np.zeros(0), 0
        dims = np.flatnonzero(query)
        q = query[dims].astype(np.int64)
        up = q > 0
        # positive numbers read their dimension from the top down, negative ones from the bottom up; what lies between a and b isn't processed
        a, b = np.zeros(len(dims), np.int64), np.full(len(dims), n)
        level = int((np.where(up, self.values[dims, -1], self.values[dims, 0]) * q).max(initial=0))
        total, known, processed = np.zeros(n), np.zeros(n, bool), 0
        best, beat = np.zeros(0), -np.inf
        while True:
            # halves, as long as what is open may weigh more than a part of the score to beat
            level = level // 2 if level * len(dims) > max(beat, 0) * SMALL else 0
            to_b = np.where(up, self.begin(dims, -(-level // q)), b)
            to_a = np.where(up, a, self.begin(dims, level // q + 1))
            parts = [(d, slice(x, y)) for d, x, y in zip(dims.tolist(), np.where(up, to_b, a).tolist(), np.where(up, b, to_a).tolist()) if x < y]
            if parts:
                at = np.concatenate([self.order[d, x] for d, x in parts])
                # the number of processed dimensions goes into the sums' fractions
                total += np.bincount(at, np.concatenate([self.values[d, x] * query[d] for d, x in parts]) + COUNT, n)
                processed += len(at)
            a, b = to_a, to_b
            # the best of those that aren't scored yet, by their sums
            some = np.argpartition(total, n - k)[n - k :]
            some = some[~known[some]]
            known[some] = True
            best = np.sort(np.concatenate((best, self.scores(query, some))))[-k:]
            beat = best[0] if len(best) == k else beat
            whole = np.floor(total)
            possible = np.flatnonzero(whole + (len(dims) - (total - whole) / COUNT) * level >= beat)
            if level == 0 or len(possible) <= max(4 * k, n * FEW):
                return possible, self.scores(query, possible), processed


def search(df: DataFrame, is_query: Column, k: int = K, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, <id>, score: of each row that is_query selects the k other rows with the highest inner products."""
    spark = df.sparkSession
    small_batches(spark)
    good, v = numbers(vector, scale)
    rows = cut(df.where(good).select(F.col(f"`{id}`").alias("id"), F.coalesce(is_query & F.col(f"`{id}`").isNotNull(), F.lit(False)).alias("asks"), v.alias("v")))
    by_id = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"))
    entries = cut(rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("ids")))
    asked = cut(rows.where("asks").select("v").distinct().select(F.monotonically_increasing_id().alias("uid"), "v"))
    n, m = entries.count(), asked.count()
    n_shards, n_packs = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // PACK_ROWS))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    id_type = rows.schema["id"].dataType
    n_groups = max(1, -(-m // GROUP_QUERIES))
    # cogrouped, not joined: Spark would broadcast the packs by their size before each goes to every shard
    packs = asked.groupBy(F.pmod("uid", F.lit(n_packs)).alias("pack")).agg(F.collect_list(F.struct("uid", "v")).alias("queries"))
    packs = packs.select(F.pmod("pack", F.lit(n_groups)).cast("int").alias("group"), "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group")
    shards = entries.select(F.pmod(F.xxhash64("v"), F.lit(n_shards)).alias("shard"), "v", F.col("ids.id").alias("ids"), every)

    def find(asking: pa.Table, rows: pa.Table) -> pa.Table:
        """The k + 1 best of a shard for each query of a group."""
        uids, of, scored, same = [], [], [], []
        if asking.num_rows and rows.num_rows:
            ids = rows.column("ids").combine_chunks()
            shard = Shard(matrix(rows.column("v").combine_chunks(), width))
            for queries in asking.column("queries").combine_chunks():
                for uid, q in zip(queries.values.field("uid").to_pylist(), matrix(queries.values.field("v"), width)):
                    at, scores, _ = shard.top(q, k + 1)
                    if len(at) > k + 1:
                        high = scores >= np.sort(scores)[-(k + 1)]
                        at, scores = at[high], scores[high]
                    # of each entry its ids; only the k + 1 first of all these can be among the best
                    found = [(-int(s), i is None, i, r) for r, s in zip(at.tolist(), scores.tolist()) for i in ids[r].as_py()]
                    found = sorted(found, key=lambda p: (p[0], p[1], 0 if p[1] else p[2]))[: k + 1]
                    uids += [uid] * len(found)
                    of += [p[2] for p in found]
                    scored += [str(max(-MOST, min(MOST, -p[0]))) for p in found]
                    same += [bool((shard.vectors[p[3]] == q).all()) for p in found]
        return pa.table([pa.array(uids, pa.int64()), pa.array(of, to_arrow_type(id_type)), pa.array(scored, pa.string()), pa.array(same, pa.bool_())], ["uid", "id", "exact", "same"])

    schema = T.StructType([T.StructField(c, t) for c, t in (("uid", T.LongType()), ("id", id_type), ("exact", T.StringType()), ("same", T.BooleanType()))])
    found = packs.groupBy("shard", "group").cogroup(shards.groupBy("shard", "group")).applyInArrow(find, schema)
    found = found.withColumn("exact", F.col("exact").cast("decimal(38,0)"))
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("exact"), F.asc_nulls_last("id")))
    best = found.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "id", "exact", "same"))).alias("best"))
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "v").join(asked.hint("merge"), "v").join(best.hint("merge"), "uid")
    # one's own row, if it is there; of several with its id and vector any
    mine = F.array_position(F.transform("best", lambda b: F.coalesce(b["same"] & (b["id"] == F.col("query_id")), F.lit(False))), True)
    others = F.filter("best", lambda b, j: j + 1 != mine)
    listed = asking.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("p", "b"))
    score = F.greatest(F.least(F.col("b.exact"), F.lit(LONG).cast("decimal(38,0)")), F.lit(-LONG - 1).cast("decimal(38,0)")).cast("long")
    return listed.select("query_id", (F.col("p") + 1).alias("rank"), F.col("b.id").alias(id), score.alias("score"))
