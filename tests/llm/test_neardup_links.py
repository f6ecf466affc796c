"""Links that no centre of a bucket sees: both texts of a pair are better known to other texts, which aren't near enough."""

import random

from quillon.llm import neardup


def changed(rng, words, k, names):
    """k words, far from each other, made new: each changes SHINGLE shingles."""
    words, at = list(words), rng.sample(range(5, len(words) - 5, 7), k)
    for i in at:
        words[i] = next(names)
    return words


def test_no_pair_is_lost(spark):
    rng, names = random.Random(8), (f"n{i}" for i in range(1 << 30))
    texts, pairs = [], []
    for _ in range(500):
        a = [next(names) for _ in range(177)]
        b = changed(rng, a, 3, names)  # J = 158 / 188
        pairs.append((len(texts), len(texts) + 1))
        texts += [a, b, *[changed(rng, x, 7, names) for x in (a, b) for _ in range(4)]]  # J = 138 / 208
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert all(near(a, b) for a, b in pairs) and [p for p in pairs if got[p[0]] != got[p[1]]] == []
    linked = {a for p in pairs for a in p}
    # the others are near to nothing but, perhaps, to another text made from the same
    for k in range(0, len(texts), 10):
        for i in range(k + 2, k + 10):
            if i not in linked and not any(near(i, j) for j in range(k, k + 10) if j != i):
                assert [j for j in range(k, k + 10) if got[j] == got[i]] == [i]
