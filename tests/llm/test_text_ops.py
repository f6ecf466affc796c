"""Secrets, quality, fingerprints, language, language model and tokens against plain versions, on small inputs."""

import base64
import gzip
import hashlib
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import bpe, langid, maxent, quality, secrets, winnow

DOCS = "doc_id long, text string, source string, spans string, kept string, ids string, score string"
KEY = "AKIA" + "Z7Q2" * 5


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "x", "x", "x", "x") for i, t in enumerate(texts)], DOCS)


def base(text):
    """The base spans, by filtering all matches."""
    out = []
    for k, (p, ok) in {
        0: (re.compile("(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), lambda m: len(m[2]) >= 6),
        1: (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        2: (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }.items():
        out += [(m.start(), k, m.end()) for m in p.finditer(text) if ok(m)]
    return sorted(out)


def test_base_spans_of_random_texts():
    random.seed(3)
    bits = ["secret", "token", "API_KEY", "apikey", "=", ":", " ", "'", '"', "abc", "abcdef1", "AKIA", "AKIA" * 6, "0123456789abcdef", "é", "\n", "ſecret", "passwd", "K", "-", "ﬀ"]
    for _ in range(3000):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 14)))
        assert sorted(secrets.base_spans(text)) == base(text), text


@pytest.mark.parametrize("name", ["url", "url2", "unicode", "html", "base64", "gzip", "nested"])
def test_decoded_layers(name):
    secret = f"password = hunter2secret and {KEY}"
    hidden = {
        "url": lambda: "".join(f"%{b:02X}" for b in secret.encode()),
        "url2": lambda: urllib.parse.quote("".join(f"%{b:02x}" for b in secret.encode())),
        "unicode": lambda: "".join(f"\\u{ord(c):04x}" for c in secret),
        "html": lambda: "".join(f"&#x{ord(c):x};" for c in secret),
        "base64": lambda: base64.b64encode(secret.encode()).decode(),
        "gzip": lambda: base64.b64encode(gzip.compress(secret.encode())).decode(),
        "nested": lambda: urllib.parse.quote(base64.b64encode(zlib.compress(base64.b64encode(gzip.compress(secret.encode())))).decode(), safe=""),
    }[name]()
    text = f"é before {hidden} after"
    found, short = secrets.scan(text, 1 << 20)
    at = text.index(hidden)
    deep = [x for x in found if x[3] > 0]
    assert not short and {x[1] for x in deep} >= {0, 1}
    assert all(at <= s < e <= at + len(hidden) for s, _, e, _, _ in deep)
    assert [x[:3] for x in found if x[3] == 0] == base(text)
    if name in ("url", "unicode", "html", "base64"):  # places are exact up to a base64 group
        s, e = next((s, e) for s, k, e, *_ in deep if k == 0)
        inner = re.search(r"password = hunter2secret", secret)
        unit = len(hidden) / len(secret)
        assert abs(s - at - inner.start() * unit) <= 4 and abs(e - at - inner.end() * unit) <= 4
    clean = secrets.redacted(text, 1 << 20)
    assert hidden not in clean and clean.startswith("é before ") and clean.endswith(" after")


@pytest.mark.parametrize("width", [12, 40, 60, 64, 76])
@pytest.mark.parametrize("tail", range(0, 60, 7))
def test_ends_of_wrapped_layers(width, tail):
    whole = b"x" * (100 + tail) + b" token=abcdef12"
    for data in (whole, gzip.compress(random.Random(tail).randbytes(90).hex().encode() + b" " + whole)):
        run = base64.b64encode(data).decode()
        text = "see\n" + "\n".join(run[i : i + width] for i in range(0, len(run), width)) + "\n\nend of it"
        found, short = secrets.scan(text, 1 << 20)
        assert not short and [k for _, k, _, d, _ in found if d and k == 0] == [0]
        assert "token" not in secrets.redacted(text, 1 << 20)


@pytest.mark.parametrize("odd", [b"\0", b"\x0c", "\u00a0".encode(), b"\xa0", b"\xff\xfe"])
def test_layers_with_odd_bytes_and_further_members(odd):
    secret = b"password=hunter2secret"
    at = base64.b64encode(b"a few words " + odd + b" then " + secret).decode()
    assert [k for _, k, _, d, _ in secrets.scan(f"see {at} end", 1 << 20)[0] if d] == [0]
    two = base64.b64encode(gzip.compress(b"first " + odd) + gzip.compress(secret)).decode()
    assert [k for _, k, _, d, _ in secrets.scan(f"see {two} end", 1 << 20)[0] if d] == [0]


def test_long_layers_and_two_byte_characters():
    import lzma

    secret = b"password=hunter2secret "
    long = b"z" * 300_000 + b" " + secret + b"y" * 300_000
    for pack in (gzip.compress, zlib.compress, lzma.compress):
        text = f"see {base64.b64encode(pack(long)).decode()} end"
        found, short = secrets.scan(text, 100_000)
        assert short and [k for _, k, _, d, _ in found if d] == [0]
        found, short = secrets.scan(text, 1 << 20)
        assert not short and [k for _, k, _, d, _ in found if d] == [0]
    many = b"".join(gzip.compress(b"x" * 90_000) for _ in range(5)) + gzip.compress(secret)
    assert [k for _, k, _, d, _ in secrets.scan(base64.b64encode(many).decode(), 100_000)[0] if d] == [0]
    for code in ("utf-16", "utf-16-le", "utf-16-be"):
        for data in (secret.decode().encode(code), gzip.compress(secret.decode().encode(code))):
            assert [k for _, k, _, d, _ in secrets.scan(f"see {base64.b64encode(data).decode()} end", 1 << 20)[0] if d] == [0], code
    heavy = lzma.compress(secret, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 256 << 20, "preset": 0}])
    assert secrets.scan(base64.b64encode(heavy).decode(), 1 << 20)[1]


def test_secret_cases(spark):
    bomb = base64.b64encode(gzip.compress(b"z" * 100_000)).decode()
    df = frame(spark, [None, "", "token=abcdef", "token=abcdef", "x" * 300_000 + " secret: 'abcdefg'", bomb])
    rows = secrets.scan_secrets(df, max_layer_bytes=1000).orderBy("doc_id").collect()
    assert [len(r.spans) for r in rows] == [0, 0, 1, 1, 1, 0] and rows[5].truncated and not rows[4].truncated
    assert rows[0].kept == "x" and rows[2].spans[0].asDict() == {"kind": "assign", "start": 0, "end": 12, "depth": 0, "layers": ""}
    assert secrets.scan_secrets(df.limit(0)).count() == 0
    red = [r.text for r in secrets.redact_secrets(df).orderBy("doc_id").collect()]
    assert red[0] is None and red[2] == "[assign]"


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    rep = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(rep)


def test_quality(spark):
    random.seed(4)
    texts = ["".join(random.choice(["a", "b ", "c\n", " ", "é", "#", "\x85", "\x1c", "\t"]) for _ in range(random.randint(0, 60))) for _ in range(800)]
    for t in texts:
        assert quality.measure(t.encode()) == plain_measures(t), repr(t)
    good = " ".join(f"w{i}" for i in range(60))
    bad, worse = "few", "same words again " * 30
    df = frame(spark, [good] * 5 + [None, "", bad, worse, good + " x" * 200_000], "a").unionByName(frame(spark, [bad] * 40 + [good], None)).unionByName(frame(spark, [good] * 30, "c"))
    out = quality.apply_rules(df).collect()
    assert len(out) == df.count()
    assert all(r.kept for r in out if r.source == "c")
    assert [r.kept for r in out if r.source == "a" and r.text == good] == [True] * 5
    assert not [r for r in out if r.source is None and r.kept]  # a bad host takes its good page with it
    rates = {(r.host_docs, r.host_failed): r.host_rate for r in out}
    m = sum(f for _, f in rates) / sum(n for n, _ in rates)
    v = sum(f * f / n for n, f in rates) / sum(n for n, _ in rates) - m * m
    k = min(1000, max(1, m * (1 - m) / v - 1))
    assert all(abs(x - (f + m * k) / (n + k)) < 1e-9 for (n, f), x in rates.items())
    assert quality.apply_rules(df.limit(0)).count() == 0
    # a host needs enough documents to be rejected, and none goes for a rate that is only above the mean
    few = frame(spark, [bad] * 3, "d").unionByName(frame(spark, [good] * 70 + [bad] * 30, "e")).unionByName(frame(spark, [good] * 500, "f")).unionByName(frame(spark, [bad] * 60, "g"))
    assert {r.source for r in quality.apply_rules(few).where("host_rejected").select("source").distinct().collect()} == {"g"}


def plain_winnow(t):
    c, n = [ord(x) for x in t], min(winnow.GRAM, len(t))
    if not c:
        return [], []
    h = [int(winnow.gram_hashes(np.array(c[i : i + n], np.uint32))[0]) >> winnow.PLACE_BITS for i in range(len(c) - n + 1)]
    w, out = min(winnow.WINDOW, len(h)), []
    for s in range(len(h) - w + 1):
        low = min(h[s : s + w])
        x = (low, max(i for i in range(s, s + w) if h[i] == low))
        if not out or out[-1] != x:
            out.append(x)
    return [x[0] for x in out], [x[1] for x in out]


def test_winnowing(spark):
    random.seed(5)
    with np.errstate(over="ignore"):
        for _ in range(60):
            t = "".join(random.choice("abé𝄞"[: random.choice([1, 2, 4])]) for _ in range(random.choice([0, 1, 5, 11, 12, 13, 26, 27, 28, 60, 200, 300])))
            h, p = winnow.winnow(t)
            assert (h.tolist(), p.tolist()) == plain_winnow(t)
    texts = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(0, 600))) for _ in range(60)] + [None, "", "x"]
    rows = [(i * 7, t, "s", "x", "x", "x", "x") for i, t in enumerate(texts)] + [(None, "n", "s", "", "", "", ""), (7, "again", "s", "", "", "", "")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {}
    for r in winnow.compare_edits(df).collect():
        got.setdefault((r.doc_id, r.n_chars), r)
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), [-ord(c) for c in x[1]] + [0]))
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        e = winnow.edited(t, nxt)
        r = got[i, len(t)]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        with np.errstate(over="ignore"):
            assert r.fingerprint == winnow.shown(winnow.winnow(t)) and r.near_next == winnow.likeness(winnow.winnow(t)[0], winnow.winnow(nxt)[0])
    assert winnow.compare_edits(df.limit(0)).count() == 0


def test_winnowing_of_very_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(winnow, "PLACE_BITS", 7)
    monkeypatch.setattr(winnow, "_PLACES", np.uint64(127))
    random.seed(6)
    with np.errstate(over="ignore"):
        for n in (98, 99, 100, 101, 126, 127, 128, 199, 200, 500, 2000):
            for signs in ("ab", "abcdefgh "):
                t = "".join(random.choice(signs) for _ in range(n))
                h, p = winnow.winnow(t)
                assert (h.tolist(), p.tolist()) == plain_winnow(t)


def test_short_texts_keep_hashes_outside_an_edit():
    """The likeness to the edited text is near the exact one of all grams, also for short texts."""
    random.seed(7)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 8))) for _ in range(500)]
    off = {n: [] for n in (60, 100, 300)}
    with np.errstate(over="ignore"):
        for n, errors in off.items():
            for _ in range(100):
                t, nxt = (" ".join(random.choices(words, k=n))[:n] for _ in range(2))
                e = winnow.edited(t, nxt)
                a, b = (set(winnow.gram_hashes(np.array([ord(c) for c in x], np.uint32)).tolist()) for x in (t, e))
                near = winnow.likeness(winnow.winnow(t)[0], winnow.winnow(e)[0])
                assert n < 100 or near > 0
                errors.append(abs(near - len(a & b) / len(a | b)))
    assert [float(np.mean(e)) < bound for e, bound in zip(off.values(), (0.25, 0.15, 0.1))] == [True] * 3


def test_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    import regex
    import tiktoken

    ranks = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(6)
    texts = ["".join(random.choice(" \n\t\r\x0b\x1c\x85　  ab'sS.é1²½_-日") for _ in range(random.randint(0, 14))) for _ in range(5000)]
    for t in texts:
        assert [i for w in regex.findall(public.PATTERN, t) for i in whole.encode_ordinary(w)] == whole.encode_ordinary(t), repr(t)
    df = frame(spark, [*texts[:200], None, "", "a b " * 50_000, texts[0]]).repartition(3)
    assert bpe.merger(ranks, public.PATTERN, "x") is bpe.merger(ranks, public.PATTERN, "x")
    rows = bpe.encode(df, ranks, public.PATTERN).join(df.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == 204 and all(r.ids == whole.encode_ordinary(r.text or "") for r in rows) and rows[0].source == "s"
    back = bpe.decode(bpe.encode(df, ranks, public.PATTERN), ranks).join(df.select("doc_id", "text"), "doc_id").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    for r in bpe.digests(df, ranks, public.PATTERN).join(df.select("doc_id", "text"), "doc_id").collect():
        ids = whole.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.digests(df.limit(0), ranks, public.PATTERN).count() == 0


def corpus(n, seed):
    random.seed(seed)
    kinds = {"xx": ["lor", "ipo", "sal", "tem", "ram", "dol"], "yy": ["zuk", "vay", "wix", "kjo", "qen", "zaz"]}
    out = []
    for i in range(n):
        lang = random.choice(list(kinds))
        out.append((i, " ".join("".join(random.choice(kinds[lang]) for _ in range(random.randint(1, 2))) for _ in range(random.randint(5, 80))), lang))
    return out


def test_language_model(spark):
    rows = [*corpus(300, 7), (1000, None, "xx"), (1001, "", "xx"), (1002, "unheard-of " * 3, "yy"), (0, corpus(1, 7)[0][1], "xx")]
    df = spark.createDataFrame([(i, t, i % 5 == 1) for i, t, _ in rows], "doc_id long, text string, held_out boolean").repartition(3)
    out = maxent.score(df).collect()
    assert len(out) == len(rows)
    train = Counter(w for i, t, _ in rows if i % 5 != 1 for w in maxent.split(t or ""))
    n, v = sum(train.values()), len(train)
    texts = {i: t or "" for i, t, _ in rows}
    for r in out:
        words = maxent.split(texts[r.doc_id])
        want = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert abs(r.base_score - want) < 1e-9 * max(1, -want) and (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(train[w] > 0 for w in words), n)
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the context tells the two vocabularies apart
    assert maxent.score(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "w " * 150_000, False), (None, "a b", False), (2, "a b", None)], "doc_id long, text string, held_out boolean")
    assert sorted((r.n_tokens, r.held_out, math.isfinite(r.score)) for r in maxent.score(odd).collect()) == [(3, False, True), (3, False, True), (150_001, False, True)]


def plain_log10(shape, weights, text, counts):
    """log10 P of a text, token by token, each softmax summed over its outcomes."""
    words, total = maxent.split(text), 0.0
    mask = (1 << 64) - 1

    def hashed(b):
        return zlib.crc32(b) * 2 + 1

    def softmax(layer, group, feats, want):
        w, bits = weights[layer], shape.bits
        z = np.zeros(w.shape[1])
        for i, f in enumerate(feats):
            x = (f ^ (group * 0x9E3779B97F4A7C15)) & mask
            z += w[(i << bits) + ((x * 0xD1B54A32D192ED03 & mask) >> (64 - bits))]
        z += w[(maxent.FEATURES << bits) + group]
        e = [math.exp(v) for v in z]
        return math.log10(e[want] / sum(e))

    for at, w in enumerate(words):
        before = [words[at - k] if at >= k else None for k in (1, 2)]
        h = [0 if b is None else hashed(b) for b in before]
        e = [0 if b is None else hashed(b.rstrip(maxent.SUFFIX_SIGNS)[-2:]) for b in before]
        pair = 0x9E3779B1
        feats = [h[0] & mask, h[1] * 3 & mask, (h[0] * pair + h[1] * 5) & mask, (e[0] * pair + e[1] * 7) & mask]
        of, one, two, inner = (x[0] for x in shape.of([w], [counts[w]]))
        total += softmax(0, 0, feats, of) + inner
        if of > 1:
            total += softmax(1, int(of), feats, one) + softmax(2, int(of * maxent.SLOTS + one), feats, two)
    return total


def small_model(seed):
    random.seed(seed)
    names = [f"w{i}".encode() for i in range(40)]
    counts = {w: random.choice([1, 1, 2, 3, 40]) for w in names} | {maxent.END: 10}
    words, n = list(counts), np.array(list(counts.values()))
    shape = maxent.Shape([maxent.partition_totals(words[:9], n[:9]), maxent.partition_totals(words[9:], n[9:])])
    shape.fill(shape.leaves(words[:20], n[:20], n[:20]) + shape.leaves(words[20:], n[20:], n[20:]))
    return counts, words, n, shape


def test_scores_are_products_of_the_softmaxes():
    counts, words, n, shape = small_model(3)
    weights = [w + np.random.default_rng(k).normal(size=w.shape).astype(np.float32) for k, w in enumerate(shape.start())]
    text = "w1 w2 w3 w1 new w39 w7 w7"
    tokens = maxent.split(text)
    every = sorted(set(tokens))
    places = np.array([every.index(w) for w in tokens])
    c = [counts.get(w, 0) for w in every]
    got = maxent.log10_tokens(shape, weights, every, c, places, np.array([len(places)]))
    assert abs(got.sum() - plain_log10(shape, weights, text, Counter(counts))) < 1e-3
    # all words and the unknown one together have probability 1 after any history
    for history in ("", "w1 ", "w5 w6 "):
        size = len(maxent.split(history)) - 1
        p = 0.0
        for w in [*words, b"never seen"]:
            if w != maxent.END:
                row = [*maxent.split(history)[:-1], w]
                own = sorted(set(row))
                p += 10 ** maxent.log10_tokens(shape, weights, own, [counts.get(x, 0) for x in own], np.array([own.index(x) for x in row]), np.array([len(row)]))[size]
            else:
                row = maxent.split(history)
                own = sorted(set(row))
                p += 10 ** maxent.log10_tokens(shape, weights, own, [counts.get(x, 0) for x in own], np.array([own.index(x) for x in row]), np.array([len(row)]))[size]
        assert abs(p - 1) < 1e-3, (history, p)


def test_a_text_does_not_see_the_text_before():
    words = [b"a", b"b", b"c", b"d", b"e", maxent.END]
    rows = maxent.features(words, np.array([0, 1, 2, 5, 3]), np.array([4, 1]))
    assert (rows[0] == rows[4]).all() and (rows[0] != rows[1]).any()


def test_language_id(spark):
    rows = corpus(400, 8)
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model, bounds = langid.fit(df.where("id % 4 <> 2"))
    held = spark.createDataFrame([(i, t, x, "clash") for i, t, x in rows if i % 4 == 2] + [(-1, None, None, ""), (-2, "", None, ""), (-3, "12 !", None, ""), (-4, "zuk" * 100_000, "yy", ""), (-5, "é", None, "")], "doc_id long, text string, lang string, score string")
    out = langid.identify(held, model, bounds).collect()
    own = [r for r in out if r.doc_id >= 0]
    assert sum(r.lang_pred == r.lang for r in own) >= 0.98 * len(own)
    by = {r.doc_id: r for r in out}
    assert by[-1].lang_pred == by[-2].lang_pred == by[-3].lang_pred == "und" and by[-1].score == 0 and by[-4].lang_pred == "yy" and by[-5].lang_pred in ("xx", "yy") and by[-5].rejected
    assert all(0 <= r.score <= 1 for r in out)
    chars = model.orders[0][0] - np.uint64(1)
    for ctx in ("lor", "zzz", "  l"):
        cols = [chars] + [np.full(len(chars), ord(c), np.uint64) for c in reversed(ctx)]
        seen, new = np.exp(model.log_p(cols)).sum(0), np.exp(model.log_p([np.array([0x4E00], np.uint64)] + [c[:1] for c in cols[1:]]))[0]
        assert np.allclose(seen, 1, atol=1e-3) or (seen <= 1.001).all() and (new > 0).all()
    assert langid.identify(held.limit(0), model, bounds).count() == 0
    assert langid.fit(df.limit(0)) == (None, {})
    assert {r.lang_pred for r in langid.identify(held, None, {}).collect()} == {"und"}


def test_escape_signs_escaped_again_and_again():
    deep = 100_000
    for text in (
        "x %" + "25" * deep + " then token=abcdef12",
        "%" + "25" * deep + "74oken%" + "25" * (deep // 3) + "3Dabcdef12",
        "\\" + "u005c" * deep + "u0074oken=abcdef12",
        "&" + "#38;" * deep + "#116;oken=abcdef12",
        "token=abcdef12 %" + "25" * deep,
    ):
        found, short = secrets.scan(text, 1 << 26)
        assert not short and [text[s:e].endswith("abcdef12") for s, k, e, _, _ in found if k == 0] == [True]


def test_escaped_signs_between_layers_of_other_kinds():
    text = "%5cu0025" * 300 + "41"
    assert secrets.scan(text, 1 << 20) == ([], False)
    for inner in ("token=abcdef12", "%2574oken=abcdef12", "\\u005cu005cu0074oken=abcdef12"):
        hidden = base64.b64encode(inner.encode()).decode()
        assert [(s, k, e) for s, k, e, _, _ in secrets.scan(f"é {hidden} z", 1 << 20)[0]] == [(2, 0, 2 + len(hidden) - hidden.count("="))], inner


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, __import__("bz2").compress, __import__("lzma").compress])
def test_compressed_bytes_in_escapes(pack):
    data = pack(f"password = hunter2secret and {KEY}".encode())
    for hidden in (urllib.parse.quote(data), "".join(f"%{b:02x}" for b in data), "".join(f"\\x{b:02x}" for b in data), "".join(f"&#{b};" for b in data), "".join(f"\\u{b:04x}" for b in data)):
        text = f"é {hidden} end"
        assert {(s, k, e) for s, k, e, d, _ in secrets.scan(text, 1 << 20)[0] if d} >= {(2, 0, 2 + len(hidden)), (2, 1, 2 + len(hidden))}, hidden[:40]


def test_long_base64_takes_bounded_memory():
    import tracemalloc

    plain = "some readable text, line after line. " * 120_000 + " é token=abcdef12 "
    text = base64.b64encode(plain.encode()).decode()
    tracemalloc.start()
    found, _ = secrets.scan(text, 1 << 26)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    start = plain.encode().index(b"token")
    assert [(s, k) for s, k, _, _, _ in found] == [(start // 3 * 4 + start % 3, 0)] and most < 12 * len(text)


def test_many_wrapped_runs_take_linear_time():
    import time

    line = base64.b64encode(b"plain words here and there, all of them readable 12345678").decode()
    took = []
    for n in (1000, 8000):
        t = time.process_time()
        secrets.scan("\n\n".join(f"{line}\n{line[:-4]}{i:04d}\n{line}" for i in range(n)), 1 << 20)
        took.append(time.process_time() - t)
    assert took[1] < 24 * took[0]
