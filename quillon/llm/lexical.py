"""Ranked lexical search by the Best Position Algorithm.

The terms of a text are its longest stretches of letters, digits and characters beyond ASCII, A to Z in lower case. A document's score for an
item is the sum, over the item's different terms, of weight * gain, both whole numbers (see search() and gains()). For each of an item's terms there
is an impact list: the documents that have the term, greatest gain first. The lists are read in step; each document found is at once looked
up in all the item's other lists (direct access), which gives its whole score and marks its place in each of them as seen. A list's best
position is the end of its stretch of seen places from the top, often far behind the place read last. No unseen document stands before
it, so the sum of what the lists hold right after their best positions bounds all unseen documents' scores; reading stops when this bound is
strictly below the k-th best score (an equal score may have a smaller id).

Documents are indexed in blocks of at most BLOCK_ROWS documents and about BLOCK_POSTINGS postings, made by the task that reads them: term
and document numbers and counts, so that neither texts nor postings are shuffled. Each block finds its k best documents for each item; the k best of
these follow by a window with a limit for each item in front of its shuffle. Numbers of documents, of terms and of documents that
hold a term are sums of the blocks'. Only terms that a bit table of TABLE_BITS bits, filled with the items' terms, lets pass are
kept in the index; what passes by chance is in no item and meets none.

Cases: null and empty texts have no terms, take no part and are found by no item; a null item has no result. Repeated rows, of documents or items, are
rows of their own: each document is ranked, each item gets its own list. Null ids come after all others among equal scores. Very long
texts are read in pieces of PIECE bytes that end between terms. An empty table gives an empty result; columns but those named
take no part.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import cut, small_batches

K = 50
BLOCK_ROWS, BLOCK_POSTINGS = 16_384, 2_000_000
TABLE_BITS = 1 << 23
PIECE = 4 << 20
#: Items (rows) that are looked up together in a block, and their bytes up to which they go to all executors.
PACK, BROADCAST_BYTES = 256, 32 << 20
#: Places read of each list before the bound is looked at; it grows with the places read.
FIRST_READ = 32

#: What parts terms: all of ASCII but letters and digits. Letters A to Z become a to z.
_LETTERS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in _LETTERS)
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(text: bytes) -> Counter:
    """Each term's occurrences."""
    counts, at = Counter(), 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (m := _BETWEEN.search(text, at + PIECE)):
            end = m.start()
        counts.update(text[at:end].translate(TABLE).split())
        at = end
    return counts


def _cell(term: bytes) -> int:
    return zlib.crc32(term) % TABLE_BITS


def gains(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that a text of n terms has tf times gives, for a weight of 1."""
    if 50 * int(n.max(initial=0)) * n_docs >= 1 << 63:
        m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 50 + 50 * n.astype(np.int64) * n_docs // n_terms
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def by_gain(docs: np.ndarray, gain: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and gains of lists that stand in a row, each list with its greatest gain first, then its smallest document."""
    # in one number each: the list, the gain (under 2 ** 20, as m is at least 50) from its top down, the document
    key = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) << 36 | ((1 << 20) - 1 - gain) << 16 | docs.astype(np.int64)
    key.sort()
    return key & 0xFFFF, (1 << 20) - 1 - (key >> 16 & (1 << 20) - 1)


class Lists:
    """A block's impact lists of one item, in a row, and where each document stands in them."""

    def __init__(self, docs: np.ndarray, gain: np.ndarray, starts: np.ndarray, weights: np.ndarray):
        self.docs, self.starts = docs, starts
        self.impact = np.repeat(weights, np.diff(starts)) * gain
        self.by_doc = np.argsort(docs.astype(np.uint16), kind="stable")
        self.doc_ends = np.append(0, np.cumsum(np.bincount(docs)))
        self.seen = np.zeros(len(docs), bool)
        self.known = np.zeros(len(self.doc_ends), bool)
        self.best = starts[:-1].copy()  # the first place of each list that isn't seen

    def look_up(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of these documents; their places in all lists are seen from now on."""
        a, n = self.doc_ends[docs], self.doc_ends[docs + 1] - self.doc_ends[docs]
        first = np.cumsum(n) - n
        at = self.by_doc[np.repeat(a - first, n) + np.arange(n.sum())]
        self.seen[at] = True
        return np.add.reduceat(self.impact[at], first)

    def bound(self) -> int:
        """No document that hasn't been seen has a higher score."""
        total = 0
        for k, end in enumerate(self.starts[1:].tolist()):
            at = int(self.best[k])
            while at < end and self.seen[at]:
                gap = np.flatnonzero(~self.seen[at : min(end, at + 4096)])
                at = at + int(gap[0]) if len(gap) else min(end, at + 4096)
            self.best[k] = at
            if at < end:
                total += int(self.impact[at])
        return total

    def top(self, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, document), and how many places were read in step."""
        best: list[tuple[int, int]] = []  # (score, -document), the worst first
        read, more = 0, FIRST_READ
        longest = int(np.diff(self.starts).max(initial=0))
        while read < longest:
            at = np.concatenate([np.arange(min(a + read, b), min(a + read + more, b)) for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist())])
            docs = np.unique(self.docs[at])
            docs = docs[~self.known[docs]]
            self.known[docs] = True
            if len(docs):
                scores = self.look_up(docs)
                if len(docs) > k:
                    few = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    docs, scores = docs[few], scores[few]
                best = heapq.nlargest(k, best + [(s, -d) for s, d in zip(scores.tolist(), docs.tolist()) if s > 0])
            read += more
            more = max(more, read // 2)
            if len(best) == k and self.bound() < best[-1][0]:
                break
        return [(s, -d) for s, d in best], min(read, longest)


def _bits(terms: DataFrame) -> bytes:
    """The bit table of the terms: partial tables of each task, of a fixed size."""

    def mark(batches):
        table = np.zeros(TABLE_BITS, bool)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                table[[_cell(t) for t in term_counts(text or b"")]] = True
        for k, part in enumerate(np.split(np.packbits(table), 64)):
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "bits"])

    def add(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts[k] = parts.get(k, 0) | np.frombuffer(b, np.uint8)
        for k, part in parts.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "bits"])

    size = TABLE_BITS // 8 // 64
    parts = {r.k: bytes(r.bits) for r in terms.mapInArrow(mark, "k int, bits binary").repartition("k").mapInArrow(add, "k int, bits binary").collect()}
    return b"".join(parts.get(k, bytes(size)) for k in range(64))


#: Columns of a block besides its ids: terms, where each one's postings begin (and the end), documents, counts, and documents' terms.
_BLOCK = [("terms", T.ArrayType(T.BinaryType())), *((c, T.BinaryType()) for c in ("starts", "docs", "tfs", "ns"))]


def index(df: DataFrame, terms: DataFrame, id: str, text: str) -> DataFrame:
    """The blocks of all texts that have terms, with postings of at least all terms in the texts of the column terms."""
    table = df.sparkSession.sparkContext.broadcast(_bits(terms))
    id_type = df.schema[id].dataType
    schema = T.StructType([T.StructField(c, t) for c, t in (("ids", T.ArrayType(id_type)), *_BLOCK)])

    def build(batches):
        bits = np.unpackbits(np.frombuffer(table.value, np.uint8)).tobytes()
        ids: list[pa.Scalar] = []
        ns: list[int] = []
        docs: dict[bytes, array] = {}
        tfs: dict[bytes, array] = {}
        n_postings, kind = 0, None

        def block():
            # documents are numbered by their ids, so that equal scores are told by numbers
            own = pa.array(ids, kind)
            order = np.asarray(pc.sort_indices(own, null_placement="at_end"))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            names = sorted(docs)
            starts = np.concatenate(([0], np.cumsum([len(docs[t]) for t in names]))).astype(np.int64)
            every = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(docs[t], np.uint16) for t in names]])
            counts = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(tfs[t], np.uint32) for t in names]])
            row = [
                pa.array([own.take(pa.array(order)).to_pylist()], pa.list_(kind)),
                pa.array([names], pa.list_(pa.binary())),
                *[pa.array([x.tobytes()], pa.binary()) for x in (starts, rank[every].astype(np.uint16), counts, np.array(ns, np.int64)[order])],
            ]
            return pa.record_batch(row, ["ids", *[n for n, _ in _BLOCK]])

        for batch in batches:
            kind = batch.column(0).type
            for i, raw in zip(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()):
                counts = term_counts(raw or b"")
                if not counts:
                    continue
                for t, c in counts.items():
                    if bits[zlib.crc32(t) % TABLE_BITS]:
                        if t not in docs:
                            docs[t], tfs[t] = array("H"), array("I")
                        docs[t].append(len(ids))
                        tfs[t].append(c)
                        n_postings += 1
                ids.append(i.as_py())
                ns.append(counts.total())
                if len(ids) >= BLOCK_ROWS or n_postings >= BLOCK_POSTINGS:
                    yield block()
                    ids, ns, docs, tfs, n_postings = [], [], {}, {}, 0
        if ids:
            yield block()

    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(build, schema)


def _frequencies(blocks: DataFrame) -> DataFrame:
    """(term, df) of the terms in the blocks; and with a null term the numbers of documents and of their terms."""

    def count(batches):
        for batch in batches:
            for terms, starts, ns in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                df, n = np.diff(np.frombuffer(starts, np.int64)), np.frombuffer(ns, np.int64)
                names = pa.array([*terms.as_py(), None], pa.binary())
                yield pa.record_batch([names, pa.array(np.append(df, len(n))), pa.array(np.append(df * 0, n.sum()))], ["term", "df", "n_terms"])

    rows = blocks.select("terms", "starts", "ns").mapInArrow(count, "term binary, df bigint, n_terms bigint")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_terms").alias("n_terms"))


def _terms_of(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(term_counts(t or b"")) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.binary()))


def search(docs: DataFrame, items: DataFrame, k: int = K, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = cut(index(docs, items.select(F.col(f"`{item_text}`").alias("t")), id, text))
    stats = cut(_frequencies(blocks))
    total = stats.where("term IS NULL").first()
    n_docs, n_terms = (total.df, total.n_terms) if total else (0, 0)

    # a number of its own for each item's row, written before it is used
    numbered = cut(items.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{item_id}`").alias("item_id"), F.arrow_udf(_terms_of, "array<binary>")(F.col(f"`{item_text}`")).alias("terms")))
    n_items = numbered.count()
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = stats.where("term IS NOT NULL").select("term", weight.alias("w"))
    asked = numbered.select("uid", F.explode("terms").alias("term")).join(weights, "term")
    asked = asked.groupBy("uid").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    n_packs = max(1, -(-n_items // PACK))
    packs = asked.withColumn("pack", F.pmod(F.xxhash64("uid"), F.lit(n_packs))).groupBy("pack").agg(F.collect_list(F.struct("uid", "terms")).alias("items"))
    packs = cut(packs)

    size = packs.agg(F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + 8 + F.aggregate(x["terms"], F.lit(0).cast("long"), lambda b, t: b + 24 + F.length(t["term"]))))).first()[0] or 0
    pairs = blocks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1)))).join(F.broadcast(packs) if size <= BROADCAST_BYTES else packs, "pack")

    def rank(batches):
        for batch in batches:
            columns = {n: batch.column(j) for j, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                ids = columns["ids"][r].values
                starts, every, tfs, ns = (np.frombuffer(columns[c][r].as_py(), t) for c, t in (("starts", np.int64), ("docs", np.uint16), ("tfs", np.uint32), ("ns", np.int64)))
                place = {t: j for j, t in enumerate(columns["terms"][r].as_py())}
                every, gain = by_gain(every, gains(tfs, ns[every], n_docs, n_terms), starts)
                uids, found = [], []
                for item in columns["items"][r].as_py():
                    of = [(place[t["term"]], t["w"]) for t in item["terms"] if t["term"] in place]
                    if not of:
                        continue
                    parts = [slice(starts[j], starts[j + 1]) for j, _ in of]
                    ends = np.cumsum([0, *[p.stop - p.start for p in parts]])
                    own = np.concatenate([every[p] for p in parts]), np.concatenate([gain[p] for p in parts])
                    best, _ = Lists(*own, ends, np.array([w for _, w in of], np.int64)).top(k)
                    uids += [item["uid"]] * len(best)
                    found += best
                if found:
                    yield pa.record_batch([pa.array(uids, pa.int64()), ids.take(pa.array([d for _, d in found])), pa.array([s for s, _ in found], pa.int64())], ["uid", "doc_id", "score"])

    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", docs.schema[id].dataType), T.StructField("score", T.LongType())])
    best = pairs.drop("pack").mapInArrow(rank, schema)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(numbered.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")
