"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) P(slot | class, history) P(slot within it | class, slot, history) P(word | leaf). The first three are
softmaxes over hashed features of the history: the last word, the word before it (a skip), both words together, and the endings of both (an
ending is a word's last two letters). Each has a weight for each outcome in each of 2^bits rows a feature; a row is named by the feature and
by what has been chosen before, so that the context also decides among the words of a class. A leaf is what three choices lead to; its words have
their smoothed shares of its training tokens. bits grows with the number of distinct words (see Shape).

Classes: 0 the end of a text; 1 words seen once in training, and one symbol for all that were never seen, with the share that Good
and Turing give to unseen words (neither is divided further); then FREQUENT classes for words that make up a 256th of all tokens or so, by
hash, and SUFFIXES classes of the other words by their last two letters. Slots are by hash. All words and the
unknown symbol together have probability 1.

Training: each task runs gradient steps over its own blocks of training documents, starting from the common weights;
the changes are averaged by the tokens seen (a shuffle of chunks of weights), and the next round starts from there. Rounds
take disjoint parts of the blocks, so that each training token is used once. Word counts are summed over the
whole corpus by a shuffle of each block's distinct words (blocks.py), whose tasks also sum the tokens and words of the leaves.

Cases: a null text counts as empty, which has only its end; without training documents all words are unknown and the
classes are equally likely; null ids are kept; a null held_out counts as false; repeated rows count as often as they stand there; a very long text is
a block of its own; an empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.blocks import load, lookup_words, open_block, pack
from quillon.llm.common import cut

#: No word holds a space.
END = b" "
FREQUENT, SUFFIXES = 6, 8
CLASSES, SLOTS = 2 + FREQUENT + SUFFIXES, 16
LEAVES = CLASSES * SLOTS * SLOTS
FEATURES = 4
#: Rows of weights a feature, as a power of 2: a 512th of the distinct words or so, within these.
LEAST_BITS, MOST_BITS = 10, 15
#: Outcomes that a choice has, and the groups of outcomes chosen before.
LAYERS = ((1, CLASSES), (CLASSES, SLOTS), (CLASSES * SLOTS, SLOTS))
#: A word is frequent if its count's bit length is at least that of all tokens less this.
FREQUENT_BITS = 8
#: Bit lengths of counts are below this.
BITS = 64
#: The log weight of outcomes that no word has.
NEVER = -30.0
ROUNDS, STEP, BATCH = 2, 0.1, 2048
CHUNKS = 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SUFFIX_SIGNS, TAIL = b".,;:!?\"'()", 4
SIGNS = np.isin(np.arange(256), list(SUFFIX_SIGNS))


def split(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    words.append(END)
    return words


#: Whether a byte parts words.
PARTS = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def index(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What split() gives for each text, as distinct words, places and numbers of words: all texts at once, in Arrow."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    signs = np.frombuffer(b"".join([x for t in data for x in (t, END)]).translate(LOWER), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in data]) - 1
    word, first = ~PARTS[signs], np.ones(len(signs), bool)
    first[1:] = ~word[:-1]
    word[ends] = first[ends] = True  # an end is a word of its own; what follows one is first, as it follows a sign that parts
    offsets = np.append(np.flatnonzero(first[word]), np.count_nonzero(word))
    lens = np.diff(np.searchsorted(np.flatnonzero(first & word), ends) + 1, prepend=0)
    long = offsets[-1] >= 1 << 31
    all_words = pa.Array.from_buffers(pa.large_binary() if long else pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64 if long else np.int32)), pa.py_buffer(signs[word])])
    coded = all_words.dictionary_encode()
    _, cuts, body = coded.dictionary.buffers()
    cuts, body = np.frombuffer(cuts, np.int64 if long else np.int32)[: len(coded.dictionary) + 1].tolist(), body.to_pybytes()
    return [body[a:b] for a, b in zip(cuts, cuts[1:])], coded.indices.to_numpy().astype(np.uint32), lens


@functools.cache
def _pairs() -> np.ndarray:
    """The hash of each two letters."""
    return np.array([zlib.crc32(bytes((a, b))) for a in range(256) for b in range(256)], np.int64)


def hashes(words) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and one of its ending: its last two letters without the signs after them."""
    whole = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(bytes(TAIL) + b"".join(words), np.uint8)
    last, signs = np.cumsum(lens) + TAIL - 1, np.zeros(len(words), np.int64)
    open_ = np.arange(len(words))
    for _ in range(TAIL - 1):
        open_ = open_[SIGNS[letters[last[open_] - signs[open_]]]]
        signs[open_] += 1
    at = last - signs
    endings = _pairs()[letters[at - 1].astype(np.int64) << 8 | letters[at]]
    # what has less than two letters, or may have more signs, is stripped by itself
    for i in np.flatnonzero((lens - signs < 2) | (signs == TAIL - 1)).tolist():
        endings[i] = zlib.crc32(words[i].rstrip(SUFFIX_SIGNS)[-2:])
    return whole, endings


def is_end(words, whole: np.ndarray) -> np.ndarray:
    """The places of the end among words of these hashes."""
    return np.array([i for i in np.flatnonzero(whole == zlib.crc32(END)).tolist() if words[i] == END], np.int64)


def bit_length(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def block_counts(payload) -> np.ndarray:
    """How often training documents of a block have each of its words."""
    (_, held), words, places, lens = payload
    train = np.repeat(~np.array(held, bool), lens)
    return np.bincount(places[train], minlength=len(words)).astype(np.int64)


def partition_totals(words, counts) -> tuple:
    """Tokens (with the end's) and types, the end's tokens, words seen once and twice, of a part of all words."""
    end = np.fromiter([w == END for w in words], bool, len(words))
    c = np.where(end, 0, counts)
    return int(counts.sum()), int((counts > 0).sum()), int(counts[end].sum()), int((c == 1).sum()), int((c == 2).sum())


def choices(words, counts: np.ndarray, border: int, hashed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class and the two slots of each word, of which those with counts of border bits or more are frequent."""
    h, ending = hashed or hashes(words)
    of = np.where(bit_length(counts) >= border, 2 + h % FREQUENT, 2 + FREQUENT + ending % SUFFIXES)
    of[counts <= 1] = 1
    of[is_end(words, h)] = 0
    return of, (h >> 8) % SLOTS, (h >> 16) % SLOTS


def leaves_by_bits(words, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and types of a part of all words by the bit length of their counts and by leaf, and where these are not 0. Which words are
    frequent is known only from all parts; so a word stands both in its leaf as a frequent one and in that by its ending."""
    counts, hashed, sums = np.asarray(counts, np.int64), hashes(words), np.zeros((2, BITS * LEAVES), np.int64)
    for border in (0, BITS):
        of, one, two = choices(words, counts, border, hashed)
        some = np.flatnonzero((counts > 0) & ((border == 0) | (of > 1)))
        at = (((bit_length(counts) * CLASSES + of) * SLOTS + one) * SLOTS + two)[some]
        np.add.at(sums[0], at, counts[some])
        np.add.at(sums[1], at, 1)
    where = np.flatnonzero(sums[1])
    return where, sums[0, where], sums[1, where]


class Shape:
    """What is known of the whole corpus: tokens, types, and each leaf's tokens and types."""

    def __init__(self, totals):
        self.tokens, self.types, self.ends, self.once, twice = (sum(x) for x in zip(*totals)) if totals else (0,) * 5
        self.border = max(2, self.tokens.bit_length() - FREQUENT_BITS)
        self.bits = min(MOST_BITS, max(LEAST_BITS, self.types.bit_length() - 9))
        self.unseen = self.once / (self.once + 2 * twice) if self.once else 1.0
        self.size = self.kinds = np.zeros(LEAVES)

    def choices(self, words, counts, hashed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class and the two slots of each word; hashed are its hashes, if they are known."""
        return choices(words, np.asarray(counts, np.int64), self.border, hashed)

    def leaves(self, words, counts, here) -> np.ndarray:
        """Tokens and types by leaf, of words of which here are in a part of the corpus: over all parts a word adds up to one type."""
        of, one, two = self.choices(words, counts)
        leaf = (of * SLOTS + one) * SLOTS + two
        share = np.asarray(here) / np.maximum(counts, 1)
        return np.stack((np.bincount(leaf, here, LEAVES), np.bincount(leaf, share, LEAVES)))

    def fill(self, sums: np.ndarray) -> None:
        self.size, self.kinds = np.rint(sums[0]), np.rint(sums[1])

    def of(self, words, counts, hashed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The class and slots of each word, and log10 P(word | leaf)."""
        counts = np.asarray(counts, np.int64)
        of, one, two = self.choices(words, counts, hashed)
        leaf = (of * SLOTS + one) * SLOTS + two
        share = (counts + 0.5) / (self.size[leaf] + 0.5 * np.maximum(self.kinds[leaf], 1))
        share = np.where(counts == 0, self.unseen, np.where(counts == 1, (1 - self.unseen) / max(self.once, 1), share))
        share[of == 0] = 1.0
        return of, one, two, np.log10(np.maximum(share, 1e-300))

    def base(self, counts) -> np.ndarray:
        return np.log10((np.asarray(counts) + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def start(self) -> list[np.ndarray]:
        """The weights that training starts with: by group of outcomes, their shares. Rows of features first, then one for each group."""
        size = self.size.reshape(CLASSES, SLOTS, SLOTS).copy()
        size[1, 0, 0] += 0.5  # the unknown symbol, also where no word is seen once
        out = []
        for (groups, n), own in zip(LAYERS, (size.sum((1, 2)), size.sum(2), size)):
            w = np.zeros(((FEATURES << self.bits) + groups, n), np.float32)
            w[FEATURES << self.bits :] = np.maximum(np.log(own.reshape(groups, n) + 1e-30), NEVER)
            out.append(w)
        return out


def features(words, places: np.ndarray, lens: np.ndarray, hashed=None) -> np.ndarray:
    """The features of each token: shape (tokens, FEATURES). Before a text stands the word 0."""
    h, e = ((x.astype(np.uint64) << np.uint64(1) | np.uint64(1)).take(places) for x in hashed or hashes(words))
    lens = lens.astype(np.int64)
    starts = (np.cumsum(lens) - lens)[lens > 0]
    seconds = starts[lens[lens > 0] > 1] + 1

    def back(x, k):
        b = np.zeros(len(x), np.uint64)
        b[k:] = x[:-k]
        b[starts] = 0
        if k > 1:
            b[seconds] = 0
        return b

    pair, h1, h2 = np.uint64(0x9E3779B1), back(h, 1), back(h, 2)
    out = np.empty((FEATURES, len(places)), np.uint64)
    out[0], out[1], out[2], out[3] = h1, h2 * np.uint64(3), h1 * pair + h2 * np.uint64(5), back(e, 1) * pair + back(e, 2) * np.uint64(7)
    return out.T


def rows_of(feats: np.ndarray, group: np.ndarray | int, bits: int) -> np.ndarray:
    """The rows of weights of each token, those of its features and that of its group: shape (FEATURES + 1, tokens)."""
    out = np.empty((FEATURES + 1, len(feats)), np.intp)
    with np.errstate(over="ignore"):
        x = feats.T ^ (np.asarray(group).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x *= np.uint64(0xD1B54A32D192ED03)
    x >>= np.uint64(64 - bits)
    np.add(x.view(np.int64), (np.arange(FEATURES) << bits)[:, None], out=out[:FEATURES])
    out[FEATURES] = (FEATURES << bits) + np.asarray(group)
    return out


def exp_scores(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponential of each outcome's score, and their sum."""
    z = weights.take(rows[0], 0)
    more = np.empty_like(z)
    for own in rows[1:]:
        z += weights.take(own, 0, more, "clip")
    np.minimum(z, -2 * NEVER, out=z)  # within what a float holds
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One gradient step over a batch, with a step size that shrinks by row as its gradients add up."""
    g, total = exp_scores(weights, rows)
    g *= (1 / total)[:, None]
    g.reshape(-1)[np.arange(0, g.size, g.shape[1]) + target] -= 1
    # tokens of one row side by side, for all features at once: rows and places together are numbers of 32 bits, which are sorted without an order
    low = BATCH.bit_length()
    key = rows.astype(np.uint32) << np.uint32(low) | np.arange(len(target), dtype=np.uint32)
    key.sort(1)
    key = key.reshape(-1)
    own, order = key >> np.uint32(low), (key & np.uint32((1 << low) - 1)).astype(np.intp)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    count = np.diff(np.append(first, len(own)))
    # rows of one token are taken as they are, of two added; of others the sums, two outcomes at a time, as a complex number
    change = g.take(order.take(first), 0)
    # a whole row is written as one item
    item = np.dtype((np.void, change.itemsize * change.shape[1]))
    two = np.flatnonzero(count == 2)
    both = change.take(two, 0)
    both += g.take(order.take(first.take(two) + 1), 0)
    change.view(item)[two] = both.view(item)
    more = np.flatnonzero(count > 2)
    if len(more):
        some = count.take(more)
        start = np.cumsum(some) - some
        places = np.repeat(first.take(more) - start, some) + np.arange(some.sum())
        change.view(item)[more] = np.add.reduceat(g.take(order.take(places), 0).view(np.complex64), start, 0).view(item)
    at = own.take(first).astype(np.intp)
    size = squares.take(at) + np.einsum("ij,ij->i", change, change) / g.shape[1]
    squares[at] = size
    change *= (STEP / np.sqrt(size + 1))[:, None]
    np.subtract(weights.take(at, 0), change, change)
    weights.view(item)[at] = change.view(item)


def _log(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    e, total = exp_scores(weights, rows)
    return np.log(np.maximum(e.reshape(-1).take(np.arange(0, e.size, e.shape[1]) + target) / total, 1e-37))


def log10_tokens(shape: Shape, weights: list[np.ndarray], words, counts, places: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """log10 P of each token of some texts, whose words stand at places."""
    hashed = hashes(words)
    of, one, two, inner = shape.of(words, counts, hashed)
    feats, out = features(words, places, lens, hashed), inner[places]
    for a in range(0, len(places), 1 << 14):
        own = places[a : a + (1 << 14)]
        c, s = of[own], one[own]
        p = _log(weights[0], rows_of(feats[a : a + (1 << 14)], 0, shape.bits), c)
        deep = np.flatnonzero(c > 1)
        f = feats[a : a + (1 << 14)].T.take(deep, 1).T
        for w, group, to in ((weights[1], c[deep], s[deep]), (weights[2], c[deep] * SLOTS + s[deep], two[own][deep])):
            p[deep] += _log(w, rows_of(f, group, shape.bits), to)
        out[a : a + (1 << 14)] += p / np.log(10)
    return out


def measure_leaves(blocks: DataFrame, shape: Shape) -> None:
    """Sum the leaves' tokens and types over the words' tasks: LEAVES rows reach the driver."""

    def count(batches):
        for batch in batches:
            for data in batch.column(0):
                where, size, kinds = load(data.as_py())[1]
                bits, leaf = np.divmod(where, LEAVES)
                of = leaf // SLOTS**2
                true = (of < 2) | ((of < 2 + FREQUENT) == (bits >= shape.border))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[true]), pa.array(size[true]), pa.array(kinds[true])], ["leaf", "size", "kinds"])

    parts = blocks.where("block < 0").select("answers").mapInArrow(count, "leaf long, size long, kinds long")
    sums = np.zeros((2, LEAVES))
    for r in parts.groupBy("leaf").agg(F.sum("size").alias("size"), F.sum("kinds").alias("kinds")).collect():
        sums[:, r.leaf] = r["size"], r["kinds"]
    shape.fill(sums)


def measure_words(blocks: DataFrame) -> Shape:
    """The shape of the corpus, of which five numbers of each of the words' tasks reach the driver."""

    def totals(batches):
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in load(data.as_py())[0]], list("abcde"))

    shape = Shape([tuple(r) for r in blocks.where("block < 0").select("answers").mapInArrow(totals, "a long, b long, c long, d long, e long").collect()])
    measure_leaves(blocks, shape)
    return shape


def train(blocks: DataFrame, shape: Shape) -> list[np.ndarray]:
    """The weights of the layers."""
    weights = shape.start()
    sc, bits = blocks.sparkSession.sparkContext, shape.bits
    for turn in range(ROUNDS):
        start = sc.broadcast(weights)

        def step(batches, start=start):
            own, seen = [w.copy() for w in start.value], 0
            squares = [np.zeros(len(w), np.float32) for w in own]
            for batch in batches:
                for data, answers in zip(batch.column(0), batch.column(1)):
                    (_, held), words, places, lens = open_block(data.as_py())
                    hashed = hashes(words)
                    of, one, two = shape.choices(words, load(answers.as_py()), hashed)
                    feats = features(words, places, lens, hashed)
                    keep = np.flatnonzero(np.repeat(~np.array(held, bool), lens))
                    for a in range(0, len(keep), BATCH):
                        at = keep[a : a + BATCH]
                        w, f = places[at], feats.T.take(at, 1).T
                        descend(own[0], squares[0], rows_of(f, 0, bits), of[w])
                        deep = np.flatnonzero(of[w] > 1)
                        w, f = w[deep], f.T.take(deep, 1).T
                        if len(w):
                            descend(own[1], squares[1], rows_of(f, of[w], bits), one[w])
                            descend(own[2], squares[2], rows_of(f, of[w] * SLOTS + one[w], bits), two[w])
                    seen += len(keep)
            if seen:
                for layer, (new, old) in enumerate(zip(own, start.value)):
                    for k, part in enumerate(np.array_split(new - old, CHUNKS)):
                        yield pa.RecordBatch.from_arrays([pa.array([layer], pa.int32()), pa.array([k], pa.int32()), pa.array([seen], pa.int64()), pa.array([part.astype(np.float16).tobytes()], pa.binary())], ["layer", "chunk", "seen", "change"])

        def merge(batches):
            sums: dict = {}
            for batch in batches:
                for layer, k, n, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    a = np.frombuffer(data, np.float16).astype(np.float32).reshape(-1, LAYERS[layer][1])
                    # a row that few tasks have changed is not pulled back by those that have not
                    size = (a != 0).any(1)[:, None] * np.float32(n)
                    s, m = sums.get((layer, k), (0, 0))
                    sums[layer, k] = (s + a * size, m + size)
            for (layer, k), (s, m) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([layer], pa.int32()), pa.array([k], pa.int32()), pa.array([(s / np.maximum(m, 1)).astype(np.float32).tobytes()], pa.binary())], ["layer", "chunk", "change"])

        part = blocks.where((F.col("block") >= 0) & (F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == turn)).select("payload", "answers")
        changes = part.mapInArrow(step, "layer int, chunk int, seen long, change binary").repartition(CHUNKS, "chunk", "layer").mapInArrow(merge, "layer int, chunk int, change binary").collect()
        parts = [np.array_split(w, CHUNKS) for w in weights]
        for r in changes:
            own = parts[r.layer]
            own[r.chunk] = own[r.chunk] + np.frombuffer(r.change, np.float32).reshape(own[r.chunk].shape)
        weights = [np.concatenate(p) for p in parts]
        start.unpersist()
    return weights


def score(df: DataFrame, id: str = "doc_id", text: str = "text", held: str = "held_out") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. held names a boolean column: rows to learn nothing from."""
    rows = df.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{held}`"), F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    packed = pack(rows, "text", ["doc_id", "held_out"], index=index)
    # with a row for each task of the words' shuffle
    blocks = cut(lookup_words(packed, block_counts, lambda words, sums: sums, lambda words, sums: (partition_totals(words, sums), leaves_by_bits(words, sums))))
    shape = measure_words(blocks)
    weights = blocks.sparkSession.sparkContext.broadcast(train(blocks, shape))
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def scored(batches):
        for batch in batches:
            for data, answers in zip(batch.column(0), batch.column(1)):
                (ids, held), words, places, lens = open_block(data.as_py())
                counts = np.asarray(load(answers.as_py()), np.int64)
                base = shape.base(counts)
                log10 = log10_tokens(shape, weights.value, words, counts, places, lens)
                lens = lens.astype(np.int64)
                first = np.cumsum(lens) - lens  # each row has a token at least, its end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, arrow_id), pa.array(held, pa.bool_()), pa.array(lens), pa.array(np.add.reduceat((counts > 0)[places].astype(np.int64), first)), pa.array(np.full(len(lens), shape.tokens, np.int64)), pa.array(np.add.reduceat(base[places], first)), pa.array(np.add.reduceat(log10, first))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    return blocks.where("block >= 0").select("payload", "answers").mapInArrow(scored, schema)
