"""Features, rules, directions, augmentation and tables against plain versions and known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import augment, dsp
from quillon.operators import direction as D
from quillon.operators import episodes as E
from quillon.operators import nights as N
from quillon.operators.neighbours import centred_unit, similar_pairs
from quillon.sources import tables


def plain_frames(x, size, hop):
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / (size - 1)) for i in range(size)]
    out = []
    for a in range(0, len(x) - size + 1, hop):
        f = [v * u for v, u in zip(x[a : a + size], w)]
        out.append([abs(sum(v * complex(math.cos(2 * math.pi * k * i / size), -math.sin(2 * math.pi * k * i / size)) for i, v in enumerate(f))) for k in range(size // 2 + 1)])
    return np.array(out)


def edges(low, high, n):
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    return [700 * (10 ** ((mel(low) + (mel(high) - mel(low)) * i / (n + 1)) / 2595) - 1) for i in range(n + 2)]


def test_magnitude_features_are_padded_before_scaling():
    x = np.random.default_rng(1).normal(size=1400) * 0.1
    got = dsp.log_mel(x, dsp.MAGNITUDE)
    e, s = edges(40, 6000, 30), plain_frames(x, 512, 256)
    bank = [[max(0.0, min((k * 31.25 - e[m]) / (e[m + 1] - e[m]), (e[m + 2] - k * 31.25) / (e[m + 2] - e[m + 1]))) for k in range(257)] for m in range(30)]
    want = np.zeros((61, 30))
    want[: len(s)] = np.log(s @ np.array(bank).T + 1e-6)
    want = (want - want.min()) / (want.max() - want.min())
    assert got.shape == (61, 30) and np.allclose(got, want, atol=1e-6)
    assert not dsp.log_mel(np.zeros(100), dsp.MAGNITUDE).any()


def test_power_features_use_whole_bins():
    x = np.random.default_rng(2).normal(size=1100) * 0.1
    got = dsp.log_mel(x, dsp.POWER)
    bins = [int(513 * f / 16000) for f in edges(0, 8000, 30)]
    bank = np.zeros((30, 257))
    for m in range(30):
        a, b, c = bins[m : m + 3]
        for k in range(a, b):
            bank[m, k] = (k - a) / (b - a)
        for k in range(b, min(c, 257)):
            bank[m, k] = (c - k) / (c - b)
    want = np.log(plain_frames(x, 512, 256) ** 2 @ bank.T + 1e-9)
    want = (want - want.min()) / (want.max() - want.min() + 1e-9)
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-6)
    assert dsp.log_mel(np.ones(100), dsp.POWER).shape == (1, 30)


def rule(levels, ratio=0.9, c=E.RuleParams(), floor=E.FloorParams()):
    s = {}
    return [E.rule_step(s, v, ratio, c, floor) for v in levels], s


def test_rule_detector_known_answers():
    # default slots of -80 count; above is the mean times 1.2, so that below zero all levels are above it
    c = E.RuleParams(history=16, period_min_ms=96, period_max_ms=192, duration_min_ms=64, duration_max_ms=640)
    beat = [-20.0 if i % 4 == 2 else -30.0 for i in range(40)]
    out, s = rule(beat, c=c)
    first = next(i for i, r in enumerate(out) if r["mode"] == 2)
    ring = [-80.0] * 16
    for i, v in enumerate(beat[: first + 1]):
        ring[i % 16] = v
    peaks = [i for i in range(2, 14) if ring[i] > max(ring[i - 2], ring[i - 1], ring[i + 1], ring[i + 2])]
    assert sum(3 <= b - a <= 6 for a, b in zip(peaks, peaks[1:])) >= 2 and out[first]["confidence"] == pytest.approx(0.7 + 0.35 * 0.5)
    assert not out[0]["hit"] and out[first]["hit"] and out[first + 1]["confidence"] == 0.85
    # forced end after the longest duration, and an open event at the end
    events = E.rule_flush(s)
    assert events[0] == (32.0, 32.0 + 21 * 32.0, 0.85) and all(b > a for a, b, _ in events)
    out, s = rule(beat[: first + 2] + [-90.0], c=c)
    assert out[-1]["mode"] == 0 and [e[2] for e in E.rule_flush(s)] == [0.8]
    E.new_night(s)
    assert E.rule_flush(s) == [] and s["ring"] != [-80.0] * 16
    assert not any(r["hit"] for r in rule(beat, ratio=0.1, c=c)[0])


def test_app_spends_its_nightly_budget_once():
    c, s, out = E.AppParams(budget=2), {}, []
    for t in range(0, 40_000, 5):
        out += E.app_step(s, float(t), True, c)
    assert [x["n"] for x in out if x["mode"] == "INTERVENE" and x["level"] == 1] == [1, 2] and s["n"] == 2
    raised = [x["t"] for x in out if x["mode"] == "INTERVENE"][:3]
    assert [x["level"] for x in out if x["mode"] == "INTERVENE"][:3] == [1, 2, 3] and raised[1] - raised[0] == 15 and raised[2] - raised[1] == 5


def test_direction_of_a_delayed_source():
    x = np.random.default_rng(5).normal(size=8000) * 0.2
    left, right = x[3:], x[:-3]
    got = D.classify(left, right)
    assert got["side"] == "left" and abs(got["lag"] - 3) < 0.2 and got["confidence"] > 0.9 and abs(got["lag_ms"] - got["lag"] / 16) < 1e-9
    assert D.classify(right, left)["side"] == "right" and D.classify(left * 1e-6, right * 1e-6)["frames"] == 0
    s = {}
    D.direction_step(s, -10.0, 2.0, 9.0)
    D.new_episode(s)
    assert D.direction(s)["side"] == "unknown" and s["floor"] == -60.0


def test_augmentation_chain(spark):
    c = augment.Chain(p_response=1, p_noise_pos=1, p_noise_neg=0, p_tilt=1, p_shift=1, p_gain=1, shift=3)
    x, noise = np.random.default_rng(6).normal(size=(2, 50)) * 0.1
    u = [0.1, 0.1, 0.4, 0.1, 0.75, 0.1, 0.99, 0.1, 1.0]
    y = np.array([sum(h * x[i - k] for k, h in enumerate([1.0, 0.5]) if i >= k) for i in range(50)])
    y *= math.sqrt((x**2).mean() / (y**2).mean())
    y = y + noise * math.sqrt((y**2).mean() / (noise**2).mean()) / 10 ** (5 / 20)
    t = np.array([y[i] + 0.25 * (y[i - 1] if i else 0) for i in range(50)])
    t *= math.sqrt((y**2).mean() / (t**2).mean())
    want = np.clip(np.concatenate(([0, 0, 0], t[:-3])) * 10 ** (6 / 20), -1, 1)
    assert np.allclose(augment.chain_step(x, noise, np.array([1.0, 0.5]), 1, u, c), want)
    never = augment.Chain(0, 0, 0, p_tilt=0, p_shift=0, p_gain=0)
    df = spark.createDataFrame([(1, x.tolist(), 1), (2, None, 0), (3, [], 0)], "k long, x array<double>, y int")
    out = {r.k: r.z for r in df.select("k", augment.chain(df.x, df.y, 1, df.k, c=never).alias("z")).collect()}
    assert out[1] == x.tolist() and out[2] is None and out[3] == []


def test_batch_matrices(spark):
    m = [[0.5] * 30 for _ in range(12)]
    df = spark.createDataFrame([(i, m) for i in range(6)], "i int, x array<array<double>>")
    out = {r.i: np.array(r.z) for r in df.select("i", augment.batch_matrix(df.x, df.i, F.lit(6), 3, df.i, 0.0).alias("z")).collect()}
    assert all((out[i] == 0.5).all() for i in (3, 4, 5))  # neither shifted nor masked
    assert all(2 <= (out[i][:, :].sum(0) == 0).sum() <= 5 for i in (0, 1)) and (out[2].sum(0) > 0).all()


def test_platt_fit(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z - 0.5)))).astype(int)
    a, b = N.platt_fit(spark.createDataFrame(list(zip(z.tolist(), y.tolist())), "z double, y int"), "z", "y")
    w = np.zeros(2)
    x = np.stack((z, np.ones(400)), 1)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-4, 0]), x.T @ (p - y) + np.array([1e-4, 0]) * w)
    assert np.allclose((a, b), w, atol=1e-4)


def test_tables(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.123456789, "weak_positive"), (2, -3.0, None)], "id long, z double, flag string")
    tables.write_scores(scores, f"{tmp_path}/scores")
    assert sorted(map(tuple, tables.read_scores(spark, f"{tmp_path}/scores").collect())) == [(1, 0.123457, "weak_positive"), (2, -3.0, "")]
    tables.write_label_template(spark, f"{tmp_path}/labels")
    assert tables.read_csv(spark, f"{tmp_path}/labels", tables.LABEL_SPANS).first().posture == "supine"
    (tmp_path / "bad.csv").write_text("id,z,flag\nx,1.0,\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tables.read_scores(spark, f"{tmp_path}/bad.csv").collect()
    assert tables.read_audit(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "model.bin").write_bytes(b"abc")
    import hashlib

    sha = hashlib.sha256(b"abc").hexdigest()
    tables.check_release(f"{tmp_path}/model.bin", sha, "v5")
    for args in ((sha, "v5-Demo"), ("0" * 64, "v5")):
        with pytest.raises(ValueError):
            tables.check_release(f"{tmp_path}/model.bin", *args)
    with pytest.raises(ValueError):
        tables.check_samples(scores, 3)
    assert tables.check_samples(scores, 2) == 2


def test_traces_avoid_the_threshold():
    out = N.trace(3, 0.65, [(40, 3, 5), (6, 2, 6)], 20)
    assert len(out) == 40 * 8 + 6 * 8 + 40 and 0.65 not in out


def test_similar_pairs_in_a_full_cell(spark, monkeypatch):
    from quillon.operators import neighbours

    monkeypatch.setattr(neighbours, "CHUNK", 50)  # several chunks a cell
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.02, 0.1, 0.15, 0.3) for _ in range(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").select("id", centred_unit(F.col("x")).alias("v"))
    u = x - x.mean(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if c[i, j] >= 0.95}
    got = [(r.a, r.b) for r in similar_pairs(df, "id", "v", 0.95, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_similar_vectors_in_large_cells(spark, monkeypatch):
    """A full cell: a vector is shuffled a few times, clusters come from forests and copies are one vector."""
    from quillon.operators import neighbours

    monkeypatch.setattr(neighbours, "TILE", (64, 128), raising=False)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[i % 12] + rng.normal(size=16) * 0.03 * (i % 7) for i in range(2500)]).reshape(-1, 16)
    x[2000:] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").select("id", centred_unit(F.col("x")).alias("v"))
    u = x - x.mean(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    root, last = np.arange(len(x)), None
    while last is None or (root != last).any():
        last, root = root, np.where(near, root, len(x)).min(1)
    assert similar_pairs(df, "id", "v", 0.98, 16).count() == (near.sum() - len(x)) // 2
    links = neighbours.links(df, "id", "v", 0.98, 16)
    got = {r.id: r.root for r in neighbours.similar_clusters(df, "id", "v", 0.98, 16).collect()}
    assert [got[i] for i in range(len(x))] == root.tolist() and 1 < len(set(root)) < 2000
    assert links.count() < 20 * len(x)


def test_similar_vectors_are_kept_once(spark, monkeypatch):
    """A full cell of many chunks: blocks read the packs again, and no vector is shuffled to each chunk that it meets; rows without an id take no part."""
    from quillon.operators import neighbours

    for name, value in (("CHUNK", 64), ("TILE", (32, 64)), ("LEAF", 8)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    tables, keep = [], neighbours.kept
    monkeypatch.setattr(neighbours, "kept", lambda df: tables.append(keep(df)) or tables[-1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=16) + rng.normal(size=(900, 16)) * 0.2
    x[800:] = x[0]
    u = x - x.mean(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(f"{i:03}", f"{j:03}") for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.98, 1)))}
    assert 4950 < len(want) < 900 * 899 // 2
    df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist())], "id string, x array<double>").select("id", centred_unit(F.col("x")).alias("v"))
    out = similar_pairs(df, "id", "v", 0.98, 16)
    got = [(r.a, r.b) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    packs = tables[-1]
    assert packs.count() >= 900 / 64 and sorted(r.id for r in packs.select(F.explode("ids").alias("id")).collect()) == [f"{i:03}" for i in range(900)]
