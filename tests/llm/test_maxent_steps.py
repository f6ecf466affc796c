"""The steps of the language model that are taken for many texts or tokens at once, against plain ones."""

import random

import numpy as np

from quillon.llm import blocks, maxent


def words_of(seed, n=400):
    random.seed(seed)
    return list({bytes(random.choice(b"abc.,;:!?\"'()\xc3\xa9\0") for _ in range(random.randint(1, 9))) for _ in range(n)} | {maxent.END})


def test_words_of_all_texts_at_once():
    random.seed(4)
    bits = ["a", "B", "é", " ", "  ", "\t", "\n", "\x0b", "\f", "\r", "\0", "\x1c", "\x85", " ", "Wort", "x" * 50, "\ud800", ""]

    def plain(texts):
        ids, rows = blocks.numbering(), [maxent.split(t) for t in texts]
        places = np.array([ids[w] for row in rows for w in row])
        return list(ids), places, np.array([len(row) for row in rows])

    for texts in [[""], ["", " ", ""], *(["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(random.randint(1, 6))] for _ in range(2000))]:
        (words, places, lens), want = maxent.index(texts), plain(texts)
        assert words == want[0] and places.tolist() == want[1].tolist() and lens.tolist() == want[2].tolist(), texts


def test_hashes_of_endings():
    words = words_of(1) + [b".", b"....", b"a....", b"ab.....", b"a", b"", b"ab...", b"a..."]
    whole, endings = maxent.hashes(words)
    assert whole.tolist() == [maxent.zlib.crc32(w) for w in words]
    assert endings.tolist() == [maxent.zlib.crc32(w.rstrip(maxent.SUFFIX_SIGNS)[-2:]) for w in words]


def test_words_are_dealt_by_their_hashes():
    for words in (words_of(2), [w.decode("latin-1") for w in words_of(3)], []):
        parts, own = blocks.homes(words, 7)
        coded = [w if isinstance(w, bytes) else w.encode() for w in words]
        assert sorted(i for o in own for i in o.tolist()) == list(range(len(words)))
        for part, o in zip(parts, own):
            assert len(o) and {maxent.zlib.crc32(coded[i]) % 7 for i in o.tolist()} == {part}
            first = [coded[i][:8] for i in o.tolist()]
            assert first == sorted(first)


def test_leaves_are_summed_where_the_words_are(spark):
    """No block of texts is read again for them."""
    words = words_of(5)
    counts = np.array([random.choice([0, 1, 1, 2, 3, 9, 4000, 90_000]) for _ in words])
    counts[words.index(maxent.END)] = 70
    cuts = [0, 100, 101, len(words)]
    rows = [(-1 - k, blocks.dump((maxent.partition_totals(words[a:b], counts[a:b]), maxent.leaves_by_bits(words[a:b], counts[a:b])))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    shape = maxent.measure_words(spark.createDataFrame([*rows, (3, b"no answers to its words")], "block long, answers binary"))
    want = maxent.Shape([maxent.partition_totals(words, counts)])
    want.fill(want.leaves(words, counts, counts))
    assert (shape.tokens, shape.types, shape.ends, shape.once, shape.border) == (want.tokens, want.types, want.ends, want.once, want.border) and 2 < want.border
    assert (shape.size == want.size).all() and (shape.kinds == want.kinds).all()
    assert {0, 1} < set(np.flatnonzero(shape.kinds) // maxent.SLOTS**2)


def test_a_step_is_the_gradient_of_the_batch():
    rng = np.random.default_rng(6)
    for n, kinds in ((1, 5), (2, 1), (300, 3), (maxent.BATCH, 40), (700, 1 << 40)):
        bits, size = 6, (maxent.FEATURES << 6) + 8
        feats = rng.integers(0, kinds, (n, maxent.FEATURES)).astype(np.uint64)
        rows, target = maxent.rows_of(feats, rng.integers(0, 8, n), bits), rng.integers(0, 16, n)
        weights = rng.normal(size=(size, 16)).astype(np.float32)
        squares = rng.random(size).astype(np.float32)
        g = np.exp(sum(weights[r].astype(float) for r in rows))
        g /= g.sum(1)[:, None]
        g[np.arange(n), target] -= 1
        total = np.zeros((size, 16))
        for r in rows:
            np.add.at(total, r, g)
        hit = np.isin(np.arange(size), rows)
        new = np.where(hit, squares + (total**2).mean(1), squares)
        want = weights - maxent.STEP * total / np.sqrt(new + 1)[:, None]
        maxent.descend(weights, squares, rows, target)
        assert np.allclose(weights, want, atol=1e-4) and np.allclose(squares, new, rtol=1e-3)
