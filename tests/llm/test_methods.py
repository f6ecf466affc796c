"""Methods against their definitions: Kneser-Ney by dictionaries, URL rules one by one, hosts' priors, fingerprints of any ids."""

import datetime
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import langid, quality, urls, winnow


def normal(text):
    return re.sub(r"\s+", " ", "".join(c.lower() if c.isalpha() else " " for c in text) + " ")


def grams_of(texts):
    """Counts of four characters, the text's beginning filled up with spaces."""
    out = Counter()
    for t in map(normal, texts):
        out.update(("   " + t)[i : i + 4] for i in range(len(t)))
    return out


class Plain:
    """Interpolated Kneser-Ney of one language, by its definition."""

    def __init__(self, grams, n_characters):
        self.counts = [grams]
        for n in (3, 2, 1):
            follows = defaultdict(set)
            for g in self.counts[0]:
                follows[g[1:]].add(g)
            self.counts.insert(0, Counter({g: len(x) for g, x in follows.items()}))
        self.n_characters = n_characters

    def p(self, gram):
        n = len(gram)
        base = self.p(gram[1:]) if n > 1 else 1 / (self.n_characters + 1)
        counts = self.counts[n - 1]
        mine = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        if not mine:
            return base
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        total = sum(mine.values())
        weight = d * len(mine) / total if n > 1 else max(1e-4, d * len(mine) / total)
        return max(mine.get(gram, 0) - d, 0) / total + weight * base


def test_kneser_ney_by_dictionaries():
    texts = {"x": ["abra cadabra, abra!", "a barn", "Éa bé"], "y": ["zum zoom room", "the moon zooms", "abra"]}
    grams = {k: grams_of(v) for k, v in texts.items()}
    model = langid.Model({k: (np.array([[ord(c) for c in g] for g in v], np.uint32), np.array(list(v.values()), float)) for k, v in grams.items()})
    n = len({g[-1] for v in grams.values() for g in v})
    plain = {k: Plain(v, n) for k, v in grams.items()}
    asked = ["abra zoom", "cad qqq", "Ébé the", "", "ж abra"]
    chars, of = langid.characters(asked, langid.letter_table())
    got = np.exp(model.log_p(langid.columns(chars, of)))
    want = []
    for t in map(normal, asked):
        want += [[plain[k].p(("   " + t)[i : i + 4]) for k in ("x", "y")] for i in range(len(t))]
    assert got.shape == (len(want), 2) and np.allclose(got, want, rtol=1e-4)
    h, _ = model.entropies(asked[:3], langid.letter_table())
    sizes = [len(normal(t)) for t in asked[:3]]
    first = np.cumsum([0, *sizes])
    for i in range(3):
        assert np.allclose(h[i], [-sum(math.log(w[k]) for w in want[first[i] : first[i + 1]]) / sizes[i] for k in (0, 1)], rtol=1e-4)
    # over all characters and the unknown one a distribution
    every = sorted({g[-1] for v in grams.values() for g in v})
    assert abs(sum(plain["x"].p("abr" + c) for c in every) + plain["x"].p("abr\0") - 1) < 1e-9


def test_thousands_of_rules_equal_each_rule_run(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rules = []
    for k in range(5000):
        a, b, c = rng.sample(words, 3)
        verdict = rng.choice(["block", "allow"])
        if k % 3 == 0:
            rules.append((f"r{k}", verdict, rf"(?i)/{a}/{b}([/?]|$)", ((a, b),)))
        elif k % 3 == 1:
            rules.append((f"r{k}", verdict, rf"(?i)/({a}|{b}-{c})([/?]|$)", ((a,), (b, c))))
        else:
            rules.append((f"r{k}", verdict, rf"(?i)[?&]{a}={b}(&|$)", ((a, b),)))
    rules += [("any", "block", r"#frag$", ()), ("none", "block", r"never-there\.", (("never", "there"), ()))]
    links = []
    for i in range(300):
        k = rng.randrange(5000)
        parts = re.findall(r"w\d+", rules[k][2])
        path = {0: f"/{parts[0]}/{parts[-1]}", 1: rng.choice([f"/{parts[0]}", f"/{parts[-2]}-{parts[-1]}"]), 2: f"/x?{parts[0]}={parts[-1]}"}[k % 3]
        links.append((i, rng.choice(["http://A.example", "https://b.example", ""]) + (path.upper() if i % 7 == 0 else path) + rng.choice(["", "", "#frag", "&z=1", "/"])))
    links += [(300, None), (301, ""), (302, "http://never-there.example/"), (303, "http://x.example/" + "a/" * 20_000 + words[0]), (0, links[0][1])]
    compiled = [(n, v, re.compile(x)) for n, v, x, _ in rules]

    def plain(url):
        hits = [(v != "allow", k, n, v) for k, (n, v, x) in enumerate(compiled) if url is not None and x.search(url)]
        return min(hits)[2:] if hits else (None, "allow")

    df = spark.createDataFrame(links, "page_id long, url string")
    patterns = spark.createDataFrame([(k, n, v, x, [list(a) for a in alt]) for k, (n, v, x, alt) in enumerate(rules)], urls.PATTERNS)
    for given in (rules, patterns):
        got = sorted(((r.page_id, r.pattern, r.verdict) for r in urls.judge(df, host_rules=(), pattern_rules=given).collect()), key=str)
        assert got == sorted(((i, *plain(u)) for i, u in links), key=str)
    assert sum(p is not None for _, p, _ in got) > 150
    hosts = spark.createDataFrame([("block", "example", "/x")], urls.HOSTS)
    blocked = {r.page_id for r in urls.judge(df, host_rules=hosts, pattern_rules=()).where("verdict = 'block'").collect()}
    assert blocked == {i for i, u in links if u and re.match(r"https?://[^/]*example/x", u)}


def test_a_host_decides_on_documents_that_overstep(spark):
    good, marked = "word " + " ".join(f"w{i}" for i in range(99)), " ".join(f"w{i}$" if i < 60 else f"w{i}" for i in range(100))  # twice as many symbols as allowed
    rows = [(k, good, "clean") for k in range(60)] + [(100 + k, good, "mixed") for k in range(31)] + [(200 + k, "short", "mixed") for k in range(29)]
    rows += [(300, marked, "clean"), (301, marked, "mixed"), (302, good, None), (303, None, "clean"), (304, " ".join(f"w{i}$$$$$$" for i in range(100)), "clean")]
    got = {r.doc_id: r for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    rate = {h: next(r.host_rate for r in got.values() if r.source == h) for h in ("clean", "mixed")}
    assert rate["clean"] < 1 / 3 < rate["mixed"] < 0.6 and not any(r.host_rejected for r in got.values())
    assert got[300].kept and not got[301].kept and not got[300].base_failed and not got[301].base_failed
    for i, h in ((300, "clean"), (301, "mixed")):
        assert abs(got[i].posterior - 2 * rate[h] / (2 * rate[h] + 1 - rate[h])) < 1e-9
    assert got[304].kept == (20 * rate["clean"] <= 1 - rate["clean"]) and got[302].kept and not got[303].kept
    assert all(got[k].kept and got[k].posterior is None for k in (*range(60), *range(100, 131)))


def test_fingerprints_of_any_ids(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    shown = lambda df: sorted((str(r.edited_sha256), r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in winnow.compare_edits(df).collect())
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "last"), (3, texts[3])]
    want = shown(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    day = datetime.date(2024, 1, 1)
    for kind, make in (("string", lambda i: f"doc-{i:05d}"), ("date", lambda i: day + datetime.timedelta(i)), ("decimal(10,2)", lambda i: __import__("decimal").Decimal(i))):
        df = spark.createDataFrame([(None if i is None else make(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(5)
        assert shown(df) == want, kind
    assert winnow.compare_edits(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    assert winnow.compare_edits(spark.createDataFrame([("a", "x")], "doc_id string, text string")).select(F.col("n_chars")).first()[0] == 1
