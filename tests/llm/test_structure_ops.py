"""Near-duplicates, url filters, chat and the pipeline against plain versions, on small inputs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quillon.llm import chat, neardup, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_counts(t):
    w = (t or "").encode().split()
    return Counter([tuple(w)]) if 0 < len(w) < 5 else Counter(zip(*(w[i:] for i in range(5))))


def jp(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a if d in b)


def plain_classes(rows):
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingle_counts(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (sets[i] and sets[j] and rows[i][1] is not None and rows[j][1] is not None and jp(sets[i], sets[j]) >= 0.8 - 1e-9):
                up[max(top(i), top(j))] = min(top(i), top(j))
    out = {}
    for i in range(len(rows)):
        out.setdefault(top(i), []).append(rows[i][0])
    return sorted(sorted(x, key=str) for x in out.values())


def near_rows():
    random.seed(9)
    word = lambda: random.choice("abcdefghij") + random.choice("klmnop") + str(random.randint(0, 30))
    rows, k = [], 0
    for group in range(25):
        first = [word() for _ in range(random.choice([3, 12, 60, 150]))]
        for _ in range(random.choice([1, 1, 2, 5, 30])):
            t = list(first)
            for _ in range(random.choice([0, 0, 1, 2])):
                t[random.randrange(len(t))] = word()
            rows.append((k, " ".join(t)))
            k += 1
    line = " ".join(word() for _ in range(12))
    rows += [(k + 1, (line + "\n") * 9), (k + 2, (line + "\n") * 8 + "end of it"), (k + 3, None), (k + 4, None), (k + 5, ""), (k + 6, ""), (k + 7, " \n"), (k + 8, "one"), (k + 9, "one "), (0, rows[0][1])]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in rows], DOCS).repartition(4)
    got = {}
    for r in neardup.classes(df).collect():
        got.setdefault((r.class_id, r.doc_id if r.key is None else None), []).append(r)
    assert sorted(sorted((r.doc_id for r in g), key=str) for g in got.values()) == plain_classes(rows)
    for (name, _), g in got.items():
        assert name == min(r.doc_id for r in g) and all(r.class_size == len(g) for r in g)
    kept = neardup.distinct_documents(df)
    assert kept.columns == df.columns and kept.count() == len(got)
    assert neardup.classes(df.limit(0)).count() == 0 and neardup.distinct_documents(df.limit(0)).count() == 0


def test_hot_texts_long_texts_and_rows_that_differ_elsewhere(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(i, "the same text again", "l", f"s{i}", 0) for i in range(3000)] + [(5000, long, "l", "s", 0), (5001, long + " end", "l", "s", 0)] + [(6000, "one more", "l", x, 0) for x in "ab"]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.classes(df).collect()}
    assert got == {i: (0, 3000) for i in range(3000)} | {5000: (5000, 2), 5001: (5000, 2), 6000: (6000, 2)}
    one, two = (sorted(map(tuple, neardup.distinct_documents(d).collect())) for d in (df, df.repartition(7, "source")))
    assert one == two and [r[0] for r in one] == [0, 5000, 6000]


def test_distinct_texts_under_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(k)) for k in range(20)] + [(7, text(k)) for k in range(20, 40)] + [(None, text(3)), (5, text(4)), (7, text(25)), (None, text(25)), (7, None), (None, None)]
    df = spark.createDataFrame([(i, t, "l", "s", 0) for i, t in rows], DOCS).repartition(3)
    out = neardup.classes(df).where("key IS NOT NULL").select("key", "class_key").distinct().collect()
    assert len(out) == 40 == len({bytes(r.class_key) for r in out})
    kept = [(r.doc_id, r.text) for r in neardup.distinct_documents(df).collect()]
    want = [(5 if k == 4 else None if k < 20 else 7, text(k)) for k in range(40)] + [(7, None), (None, None)]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_pairs_in_large_mixed_buckets(spark):
    """Texts that share boilerplate (J_P 0.77) meet in the same buckets; pairs among them at 0.81 have hardly a bucket of their own."""
    random.seed(21)
    frame = [f"b{i}" for i in range(140)]
    rows = []
    for k in range(900):
        own = [f"w{k}x{i}" for i in range(20)]
        rows.append((k, " ".join(frame + own)))
        if k < 200:
            rows.append((10_000 + k, " ".join(frame + own[:4] + [f"v{k}x{i}" for i in range(16)])))
    a, b, c = (shingle_counts(rows[i][1]) for i in (0, 1, 2))
    assert 0.8 < jp(a, b) < 0.82 and jp(a, c) < 0.78
    random.shuffle(rows)
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.classes(spark.createDataFrame([(i, t, "l", "s", 0) for i, t in rows], DOCS).repartition(4)).collect()}
    assert got == {i: (i % 10_000, 2 if i % 10_000 < 200 else 1) for i, _ in rows}


def test_a_prefix_holds_a_shingle_of_every_possible_pair(spark):
    random.seed(22)
    wanted = []
    seen = np.random.default_rng(22).integers(2, 9, 1 << neardup.CELL_BITS).astype(np.int32)
    pairs = 0
    for _ in range(400):
        a = [f"w{random.randint(0, 60)}" for _ in range(random.randint(20, 120))]
        b = list(a) * random.choice([1, 1, 2])
        for _ in range(random.randint(0, 4)):
            b[random.randrange(len(b))] = f"w{random.randint(0, 60)}"
        x, y = neardup.sets_of(pa.array([" ".join(a), " ".join(b)])).to_pylist()
        if neardup.similarity(x, y) < neardup.THRESHOLD:
            continue
        pairs += 1
        (e, p), (f, q) = neardup.prefix(x, seen), neardup.prefix(y, seen)
        p, q = dict(zip(e.tolist(), p)), dict(zip(f.tolist(), q))
        shared = p.keys() & q.keys()
        assert any(1 / (1 - p[s]) + 1 / (1 - q[s]) <= 1 + 1 / neardup.THRESHOLD + 1e-5 for s in shared)
        # and the filter of the join lets the pair through
        rows = [(min(p.items(), key=lambda i: i[1] + q.get(i[0], 9))[0], t) for t in (x, y)]
        e = rows[0][0]
        wanted.append([(float(z[e]), neardup.marks(t).tolist(), len(neardup._set(t)[0]), float(neardup._set(t)[1].sum())) for z, t in ((p, x), (q, y))])
    assert pairs > 50
    kind = "struct<p: double, marks: array<bigint>, n: int, weight: double>"
    df = spark.createDataFrame([tuple(r) for r in wanted], f"a {kind}, b {kind}")
    assert df.where(neardup._possible()).count() == pairs


def test_signatures_estimate_similarity():
    random.seed(10)
    with np.errstate(over="ignore"):
        diffs = []
        for _ in range(30):
            a = [f"w{random.randint(0, 40)}" for _ in range(120)]
            b = list(a)
            for _ in range(random.randint(0, 12)):
                b[random.randrange(120)] = "x"
            texts = pa.array([" ".join(a), " ".join(b)])
            data, bounds = next(neardup.slices(texts))
            own, h, n = neardup.shingles(data, bounds)
            assert Counter(n[own == 0].tolist()) == Counter(shingle_counts(" ".join(a)).values())
            sig = neardup.signatures(own, h, n, 2)
            want = jp(shingle_counts(" ".join(a)), shingle_counts(" ".join(b)))
            diffs.append((sig[0] == sig[1]).mean() - want)
            x, y = neardup.sets_of(texts).to_pylist()
            assert abs(neardup.similarity(x, y) - want) < 1e-9
    assert abs(np.mean(diffs)) < 0.03 and max(map(abs, diffs)) < 0.2


def test_urls(spark):
    rows = [
        ("https://a.net/x", "net/", "block"), ("https://a.NET", None, "allow"), ("https://A.example.net/en/1", "example.net/en/", "allow"), ("http://example.net/de/", "net/", "block"),
        ("http://example.com/de/x?y", "example.com/de/", "block"), ("http://notexample.com/de/x", None, "allow"), ("http://x.org/fr/", "org/fr/", "allow"), ("https://spam-farm.example.org/es/750", None, "block"),
        ("https://m.spam-farm.org/es/750.html", None, "allow"), ("https://m.x.org/es/75.html", None, "allow"), ("//no", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("ftp://h.com/a.zip", None, "block"),
        ("http://u.com/a/out?to=https://v.com", None, "block"), ("http://u.com/x?utm_source=feed", None, "block"), ("x://net/", "net/", "block"), ("x://" + "y" * 100_000 + ".net/", "net/", "block"), ("https://a.net/x", "net/", "block"),
    ]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, (u, _, _) in enumerate(rows)], "page_id long, url string, host string, verdict string").repartition(3)
    out = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(out) == len(rows)
    for i, (u, rule, verdict) in enumerate(rows):
        assert (out[i].rule, out[i].verdict) == (rule, verdict), u
    assert out[2].host == "a.example.net" and out[2].path == "/en/1" and out[11].host == "" and out[1].path == ""
    assert urls.judge(df.limit(0)).count() == 0


def test_redirects_to_http(spark):
    rows = ["http://u.com/a/out?to=http://v.com", "http://u.com/click/xhttp%3A//v", "HTTP://u.com/redirect?u=xhttps://v", "http://u.com/out", "http://u.com/http://v"]
    out = {r.url: (r.pattern, r.verdict) for r in urls.judge(spark.createDataFrame([(u,) for u in rows], "url string")).collect()}
    assert [out[u] for u in rows] == [("click-redirect", "block")] * 3 + [(None, "allow")] * 2


def test_matches_have_their_rules_tokens(spark):
    matches = {
        "spam-host": ["http://spam-farm.", "x://a.b.SPAM-farm.org/", "x://u:p@a.spam-farm.c"],
        "tracked-feed": ["?utm_source=feed", "x&UTM_SOURCE=feed&y", "a?utm_source=Feed#"],
        "click-redirect": ["/redirect?u=https:", "/out/http:", "/click?xhttps%3A", "/redirect/1http%3a", "/OUT?https:"],
        "archive": ["a.zip", "b.tar.gz?x", "c.EXE#", "d.tar.gz"],
        "mobile-article": ["http://m.a/xx/1.html", "https://M.a.b/yy/22.HTML"],
    }
    assert set(matches) == {r[0] for r in urls.PATTERN_RULES}
    rows = [(u, [list(a) for a in r[3]], r[2]) for r in urls.PATTERN_RULES for u in matches[r[0]]]
    df = spark.createDataFrame(rows, "url string, alternatives array<array<string>>, regex string")
    wrong = df.withColumn("own", urls.tokens_of(df.url)).where("NOT url RLIKE regex OR NOT exists(alternatives, a -> size(array_except(a, own)) = 0)")
    assert wrong.collect() == [] and all(r[3] for r in urls.PATTERN_RULES)


def plain_chat(rows):
    """Parents by a scan of all earlier messages."""
    import re

    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()

    def parse(text):
        out = []
        for line in re.split(r"\r?\n", text or ""):
            m = re.match(r"[ \t]*(?:>[ \t]?)+", line)
            out.append((m[0].count(">") if m else 0, line[len(m[0]) :] if m else line))
        return [(-1 if lv == 0 and re.search(r"(?i)wrote:\s*$", b) and i + 1 < len(out) and out[i + 1][0] > 0 else lv, b) for i, (lv, b) in enumerate(out)]

    own = {}
    for c, t, x in rows:
        text = "\n".join(b for lv, b in parse(x) if lv == 0).strip()
        own.setdefault((c, t), set()).update(norm(u) for u in [text, *re.split(r"\n\s*\n", text), *text.split("\n")] if norm(u))
    parent, facts = {}, []
    for c, t, x in rows:
        runs, lines = [], parse(x)
        for lv, b in lines:
            if runs and runs[-1][0] == lv:
                runs[-1][1].append(b)
            else:
                runs.append((lv, [b]))
        clean = re.sub(r"\n{3,}", "\n\n", "\n".join(b for lv, b in lines if lv == 0)).strip()
        passages = [(lv, body) for lv, body in runs if lv > 0 and any(norm(u) for u in body)]
        linked = 0
        for lv, body in passages:
            found = None
            for u in ["\n".join(body), *body]:
                first = min((k for (d, k), us in own.items() if d == c and norm(u) and norm(u) in us), default=None)
                if first is not None and first < t:
                    found = first
                    break
            linked += found is not None
            if lv == 1 and found is not None:
                parent.setdefault((c, t), found)
        facts.append((c, t, len(passages), linked, max((lv for lv, _ in passages), default=0), clean))
    return parent, facts


def test_chat(spark):
    random.seed(11)
    rows, said = [], {}
    for c in range(12):
        for t in range(random.randint(1, 30)):
            parts = [f"{random.choice(['yes', 'no', 'well'])} {random.randint(0, 60)}." for _ in range(random.randint(0, 3))]
            if t and random.random() < 0.7:
                old = random.choice(said[c]).split("\n")
                quote = [random.choice(["> ", ">", "  > ", "> > "]) + x.upper() for x in old[: random.randint(1, 3)]]
                parts = random.choice([["On Monday, Bo wrote:"], []]) + quote + parts
            rows.append((c, t, "\n".join(parts)))
            said.setdefault(c, []).append("\n".join(parts))
    df = spark.createDataFrame([(c, t, "user", x, "clash") for c, t, x in rows] + [(None, 1, "user", "> x", ""), (3, None, None, None, "")], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    out = chat.format_chat(df).collect()
    assert len(out) == len(rows) + 2
    parent, facts = plain_chat(rows)
    assert len(parent) > 20
    mine = [(r.conv_id, r.turn, r.n_passages, r.n_linked, r.max_level, r.clean_text) for r in out if r.conv_id is not None and r.turn is not None]
    assert sorted(mine) == sorted(facts)
    for r in out:
        if r.conv_id is None or r.turn is None:
            assert r.parent_turn is None and r.depth == 0
            continue
        up, depth = r.turn, 0
        while (r.conv_id, up) in parent:
            up, depth = parent[r.conv_id, up], depth + 1
        assert (r.parent_turn, r.root_turn, r.depth) == (parent.get((r.conv_id, r.turn)), up, depth)
        assert ">" not in r.clean_text and "wrote:" not in r.clean_text.replace("On Monday, Bo wrote:", "") or not r.n_passages
    assert chat.format_chat(df.limit(0)).count() == 0
    whole = {r.conv_id: r for r in chat.conversations(df).where("conv_id IS NOT NULL AND part.root >= 0").collect()}
    assert len(whole) == 12 and chat.conversations(df).count() == 14 and chat.conversations(df.limit(0)).count() == 0
    clean = {f[:2]: f[5] for f in facts}
    for c, r in whole.items():
        order = sorted((t, root) for d, t, root in ((x.conv_id, x.turn, x.root_turn) for x in out if x.conv_id == c and x.turn is not None))
        assert [m.turn for m in r.chat] == [t for t, _ in sorted(order, key=lambda x: (x[1], x[0]))]
        assert r.chat_text == "\n\n".join(f"user: {clean[c, m.turn]}" for m in r.chat) and r.n_messages == len(r.chat)


def test_long_messages_and_conversations(spark):
    quoted = "\n".join(f"{'>' * (1 + i // 3 % 2)} line {i}" for i in range(100_000))
    rows = [(1, 0, "user", "line 7"), (1, 1, "user", quoted)] + [(2, t, "user", f"> word {t - 1}\nword {t}" if t else "word 0") for t in range(2500)]
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.n_messages) for r in out] == [(1, 2), (2, 1000), (2, 1000), (2, 500)]
    assert out[0].n_passages == 33334 and out[0].n_linked == 1 and out[0].chat[1].text == ""
    assert [m.turn for r in out[1:] for m in r.chat] == list(range(2500)) and out[3].chat[-1].depth == 2499


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    random.seed(12)
    good = lambda: " ".join(f"word{random.randint(0, 5000)}" for _ in range(80))
    texts = [good() for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, "short", "en", "s0", 5), (101, texts[0], "en", "s1", 0), (102, texts[1] + " more", "en", "s2", 0), (103, texts[2] + " secret=abcdefgh12", "en", "s0", 0), (104, None, None, None, None), (105, good(), "en", None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs)
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert ids[0] == [*range(40), 101, 102, 103, 105] and ids[1] == [*range(40), 105] and ids[2] == ids[1]
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in seen[:4])
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    assert sorted(r.doc_id for r in P.run(spark, str(tmp_path)).collect()) == ids[4]


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P

    text = " ".join(f"word{i}" for i in range(80))
    names = ["doc_id", "text", "lang", "source", "n_chars", "kept", "measures", "host", "host_rate", "a.b", "hash", "taken", "key", "spans", "size"]
    rows = [(1, text, "en", "s", 1, "mine", "m", "h", "r", "dot", "x", "t", "k", "p", "z"), (2, "few", "en", "s", 1, *["-"] * 10), (3, None, None, None, None, *[None] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names[5:]))
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        assert {r[5:] for r in docs.collect()} <= {rows[0][5:]}
    assert P.STAGES[4][1](spark, docs, str(tmp_path)).columns[0] == "doc_id"
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
