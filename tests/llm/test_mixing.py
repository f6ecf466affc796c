"""Targets against repeated resharing, takes against targets, and the cases of the docstring."""

from pyspark.sql import functions as F

from quillon.llm import mixing as M

S = "doc_id long, text string, source string, hash string"


def reshare(sizes, weights, share, most):
    """Budget by weight; what is above a stop is given to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, budget = {}, set(order), share * sum(sizes.values())
    while left:
        level = (budget - sum(target.values())) / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in left}
        for s in over:
            target[s] = most * sizes[s]
        left -= over
    return target


def rows():
    out, k = [], 0
    for s, n, words in (("a", 300, 7), ("b", 40, 3), ("c", 400, 11), (None, 100, 5), ("d", 3, 2), ("é", 60, 40)):
        for _ in range(n):
            out.append((k, " ".join(["w"] * (words + k % 5)), s, "clash"))
            k += 1
    return out


def test_targets_and_takes(spark):
    df = spark.createDataFrame(rows(), S)
    got = M.mix_report(df).collect()
    sizes = {}
    for r in rows():
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[1].split())
    want = reshare(sizes, M.WEIGHTS, M.SHARE, M.MOST_REPEATS)
    taken, most = {}, {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
    assert sorted(got) == sorted(M.mix_report(df.repartition(7)).collect())  # reruns agree
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    by = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(M.size_of()).alias("n")).collect()}
    assert by == {s: n for s, n in taken.items() if n}


def test_cases(spark):
    df = spark.createDataFrame([(None, None, None, ""), (1, "", "a", ""), (2, "x y", "a", ""), (2, "x y", "a", ""), (3, "z z " * 1000, "b", "")], S)
    got = M.mix_report(df).collect()
    assert len(got) == 5 and {r.size for r in got if r.doc_id == 3} == {1000}
    assert len({r.taken for r in got if r.doc_id == 2}) == 1
    assert M.mix_report(df.limit(0)).count() == 0 and M.mix(df.limit(0)).count() == 0
