"""Top-k search, lexical search and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lexical, runs, topk

# --- top-k ---


def plain_topk(rows, k, scale=256):
    """(query id, rank, id, score) of rows (id, vector or None), by all products."""
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(good):
        if q is None or q % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(u, v)), i is None, i or 0, i) for b, (i, v) in enumerate(good) if b != a]
        out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found_topk(spark, rows, k):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = topk.search(df, F.col("vec_id") % 50 == 0, k)
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()), key=str)


@pytest.mark.parametrize("shape", ["spread", "few values", "one hot vector"])
def test_topk_is_exact(spark, shape):
    rng = np.random.default_rng(len(shape))
    v = rng.normal(0, 0.2, (700, 12))
    if shape == "few values":
        v = np.round(v * 5) / 5  # many ties
    if shape == "one hot vector":
        v[rng.random(700) < 0.4] = v[0]
    rows = [(int(i) * 10, x.tolist()) for i, x in enumerate(v)]
    assert found_topk(spark, rows, 5) == plain_topk(rows, 5)


def test_topk_cases(spark):
    rows = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (50, [0.5]), (50, [-1.0, 2.0]), (None, [3.0, 3.0]), (None, [3.0, 3.0]), (7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (11, []), (100, []), (12, [-0.001, 0.001])]
    for k in (1, 3, 5, 40):
        assert found_topk(spark, rows, k) == plain_topk(rows, k), k
    assert found_topk(spark, [], 5) == [] and found_topk(spark, [(0, [1.0])], 5) == []


def test_topk_of_large_numbers(spark):
    rows = [(50 * i, [float(1 << (10 + 2 * i)), -float(3**i), 1.0]) for i in range(12)]
    want = plain_topk(rows, 4)
    assert found_topk(spark, rows, 4) == [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in want]


def test_topk_stops_early():
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 40, (30, 32))
    shard = topk.Shard(np.floor(np.repeat(centre, 100, 0) + rng.normal(0, 4, (3000, 32))))
    at, scores, processed = shard.top(shard.vectors[0], 6)
    every = shard.vectors @ shard.vectors[0]
    assert processed < 0.6 * shard.vectors.size and len(at) < 600
    assert sorted(scores)[-6:] == sorted(every)[-6:]


# --- lexical search ---


def plain_search(docs, items, k):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    upper = {c: c + 32 for c in range(65, 91)}
    counts = [(i, Counter(term.findall((t or "").translate(upper)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n // total
            score = 0
            for t in set(term.findall((text or "").translate(upper))):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found_search(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(3)
    i = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, uid int")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(d, i, k).collect()), key=str)


@pytest.mark.parametrize("block", [16_384, 40])
def test_lexical_search_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", block)
    random.seed(block)
    words = [f"w{i}" for i in range(60)] + ["É", "ﬀ", "Straße", "x1", "X1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i % 290, random.choice(" ,.\n").join(random.choices(words, weights, k=random.randint(0, 80)))) for i in range(300)]
    docs += [(None, "w1 w2 w59"), (None, "w1 w2 w59"), (400, None), (401, ""), (402, "-- \x00 !"), (403, "w7 " * 5000)]
    items = [(i, " ".join(random.choices(words, k=random.randint(1, 12)))) for i in range(20)] + [(3, "w0 w1"), (3, "w0 w1"), (None, "W5"), (77, None), (78, "nothing here"), (79, "")]
    assert found_search(spark, docs, items, 7) == plain_search(docs, items, 7)


def test_lexical_search_of_nothing(spark):
    assert found_search(spark, [], [(1, "a")], 5) == [] and found_search(spark, [(1, "a")], [], 5) == [] and found_search(spark, [(1, None)], [(1, "a")], 5) == []


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 10)
    text = b"Abc abcdefghijklmnopqrstuvwxyz,abc \xc3\xa9\xc3\xa9\xc3\xa9\xc3\xa9\xc3\xa9\xc3\xa9 a" * 20
    assert lexical.term_counts(text) == Counter(text.translate(lexical.TABLE).split())


def test_best_positions_stop_before_the_ends_of_lists():
    rng = np.random.default_rng(1)
    n = 8000
    gain = np.sort(rng.integers(1, 900_000, (3, n)), 1)[:, ::-1]
    docs = np.stack([rng.permutation(n) for _ in range(3)])
    docs[1:, :400] = docs[0, :400]  # documents that lead all lists
    for j in (1, 2):
        rest = np.setdiff1d(np.arange(n), docs[0, :400])
        docs[j, 400:] = rng.permutation(rest)
    weights = np.array([5, 3, 2])
    best, read = lexical.Lists(docs.ravel().astype(np.int64), gain.ravel(), np.arange(4) * n, weights).top(10)
    total = np.zeros(n, np.int64)
    for j in range(3):
        total[docs[j]] += weights[j] * gain[j]
    assert best == sorted(((int(s), i) for i, s in enumerate(total)), key=lambda x: (-x[0], x[1]))[:10]
    assert read < n / 4


# --- periodic runs ---


def plain_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        j = 0
        while j + q < len(x):
            k = j
            while k + q < len(x) and x[k] == x[k + q]:
                k += 1
            size = k - j + q
            if k > j and size >= max(6, 4 * q) and not any(all(x[t] == x[t + d] for t in range(j, j + size - d)) for d in range(1, q)):
                out.append((j, size, q))
            j = k + 1
    return sorted((s, n, q) for s, n, q in out)


def test_runs_of_random_words():
    random.seed(4)
    for _ in range(1500):
        texts = []
        for _ in range(random.randint(1, 4)):
            w = [random.choice("abcde"[: random.randint(1, 5)]) for _ in range(random.randint(0, 50))]
            if w and random.random() < 0.7:
                a = random.randrange(len(w))
                p = w[a : a + random.randint(1, 9)]
                w = w[:a] + (p * 30)[: random.randint(0, 60)] + w[a:]
            texts.append(w)
        words = [[c.encode() for c in t] for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        want = sorted((s + int(bounds[i]), n, q) for i, t in enumerate(texts) for s, n, q in plain_runs(t))
        assert runs.runs_of(runs.named(words), bounds) == want, texts


def plain_result(doc_id, text):
    """The digest columns of one document, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = None
    for r in sorted(found, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(kept))


def test_periodic_runs_query(spark, tmp_path):
    from quillon.llm.queries import QUERIES

    random.seed(9)
    docs = [(i, " ".join(random.choice(["a", "b", "cé", "d d"]) for _ in range(random.randint(0, 90)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, " \x0b\t\r\n "), (903, "x\x0bx\tx\rx x  x\nx"), (904, "ab " * 400), (905, "one two three " * 9), (905, "one two three " * 9), (None, "a b a b a b a b"), (906, None)]
    spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted((plain_result(*d) for d in docs), key=str)


def test_runs_columns(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", "x")], "doc_id long, text string, best string")
    row = runs.find_runs(df).first()
    assert [tuple(r) for r in row.runs] == [(0, 8, 2)] and row.collapsed == "a b c" and row.text == "a b a b a b a b c" and tuple(row.best) == (0, 8, 2)
    assert runs.find_runs(df.limit(0)).count() == 0


def test_topk_sends_nothing_to_all_executors(spark, monkeypatch, capsys):
    """Many shards and groups: packs of queries go to every shard, which must not be done by a broadcast through the driver."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "PACK_ROWS", 2)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 4, raising=False)
    rng = np.random.default_rng(11)
    rows = [(int(i) * 10, x.tolist()) for i, x in enumerate(rng.normal(0, 0.2, (400, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("vec_id") % 50 == 0, 5)
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()), key=str) == plain_topk(rows, 5)
    capsys.readouterr()
    got.explain()
    assert "Broadcast" not in capsys.readouterr().out
