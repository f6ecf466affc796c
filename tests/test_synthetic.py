"""Noise by counter, nights by blocks, sample streams, caches by fingerprint, golden files and feature specs, against plain versions."""

import math
import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import dsp, noise
from quillon.functions.hashing import uniform
from quillon.operators import night_audio as N
from quillon.sources import audio, cache, golden
from quillon.streaming import frames


def test_pink_noise_by_units():
    n = 1 << 16
    x = noise.pink(7, np.arange(n))
    assert np.array_equal(x[1000:1100], noise.pink(7, np.arange(1000, 1100)))  # any part is the same
    # a running form: unit k is drawn anew every 2 ** (k + 1) samples
    for i in (0, 1, 2, 255, 256, 4711):
        want = sum(noise.normals(7, k, np.array([i >> (k + 1)]))[0] for k in range(8)) + noise.normals(7, 8, np.array([i]))[0]
        assert abs(x[i] - 0.1 * want / noise.PINK_PEAK) < 1e-12
    power = np.abs(np.fft.rfft(x * np.hanning(n))) ** 2
    hz = np.arange(len(power)) / n
    edges = 2.0 ** np.arange(-8, -1)
    level = [10 * math.log10(power[(hz >= a) & (hz < 2 * a)].mean()) for a in edges]
    slope = np.polyfit(np.log2(edges), level, 1)[0]
    assert -4.2 < slope < -1.8 and np.abs(x).max() < 1.2  # about 3 dB an octave


def test_synthetic_columns(spark):
    one = audio.synthetic_noise(spark, 12, 4000).repartition(5).collect()
    two = audio.synthetic_noise(spark, 12, 4000).repartition(2).collect()
    assert {r.id: r.x for r in one} == {r.id: r.x for r in two}
    got = {r.family: np.array(r.x) for r in one}
    assert set(got) == set(noise.FAMILIES) and all(len(x) == 4000 and np.abs(x).max() <= 1 and x.std() > 0 for x in got.values())
    for family, hz in (("tone_1000", 1000), ("tone_100", 100)):
        assert np.abs(np.fft.rfft(got[family])).argmax() == hz
    tones = [np.array(r.x) for r in audio.synthetic_tones(spark, 20, 4000).collect()]
    peaks = [int(np.abs(np.fft.rfft(x))[20:400].argmax()) + 20 for x in tones]
    assert all(np.abs(x).max() <= 1 for x in tones) and 40 < np.median(peaks) < 150
    row = spark.range(1).select(noise.pink_column(F.lit(3), 50, first=10).alias("a"), noise.pink_column(F.lit(3), 100).alias("b")).first()
    assert row.a == row.b[10:60]


SPEC = N.NightSpec(rate=50, duration_s=300.0, snr_db=12.0, bed_dbfs=-30.0, episodes=(2, 4), episode_s=(10.0, 30.0), distractors=(3, 6), gap_s=15.0, block=1300)


@pytest.fixture(scope="module")
def night(spark):
    rng = np.random.default_rng(2)
    table = lambda sizes, first: spark.createDataFrame([(first + i, rng.normal(0, 1, n).tolist()) for i, n in enumerate(sizes)], "id long, x array<double>")
    return spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "night string"), table([900, 7000, 1300], 0), table([50, 50, 40], 10), table([60, 50], 20)


def test_nights_equal_a_plain_loop(spark, night):
    nights, beds, pulses, distractors = night
    blocks, episodes = N.night_blocks(nights, "night", beds, pulses, distractors, 3, SPEC)
    got = {(r.night, r.block): np.array(r.x) for r in blocks.collect()}
    n = SPEC.samples
    assert sorted(got) == [(k, b) for k in "abc" for b in range(12)] and all(len(x) == (1300 if b < 11 else n - 11 * 1300) for (_, b), x in got.items())
    spans = {k: [(r.start_s, r.end_s) for r in episodes.orderBy("episode").collect() if r.night == k] for k in "abc"}
    assert all(2 <= len(s) <= 4 and all(b + 15 <= c for (_, b), (c, _) in zip(s, s[1:])) and s[-1][1] + 15 <= 300 for s in spans.values())

    u = {}

    def draw(*parts):
        if parts not in u:
            u[parts] = spark.range(1).select(uniform(3, *[F.lit(p) for p in parts]).alias("u")).first().u
        return u[parts]

    sound = {k: [r.x for r in t.orderBy("id").collect()] for k, t in (("bed", beds), ("pulse", pulses), ("distractor", distractors))}
    events = N.pulses_of(episodes, "night", 3, SPEC).unionByName(N.distractors_of(nights.distinct(), episodes, "night", 3, SPEC)).collect()
    assert {e.kind for e in events} == {"pulse", "distractor"}
    for k in "abc":
        bed = np.array(sound["bed"][min(int(draw("bed", k) * 3), 2)])
        start = int(draw("from", k) * len(bed))
        x = np.tile(bed, n // len(bed) + 2)[start : start + n]
        level = 10 ** (SPEC.bed_dbfs / 20)
        x = x * level / np.sqrt((x**2).mean())
        for e in events:
            if e.night != k:
                continue
            mine = sound[e.kind]
            w = np.array(mine[min(int(draw("sound", k, e.kind, e.id) * len(mine)), len(mine) - 1)])
            db = SPEC.snr_db if e.kind == "pulse" else 20 * draw("loudness", k, e.kind, e.id)
            w = w * level * 10 ** (db / 20) / np.sqrt((w**2).mean())
            a = int(e.t * SPEC.rate)
            x[a : a + len(w)] += w[: max(0, n - a)]
            inside = any(s - 2 <= e.t <= t + 2 for s, t in spans[k])
            assert inside == (e.kind == "pulse")
        assert np.allclose(np.concatenate([got[k, b] for b in range(12)]), np.clip(x, -1, 1), atol=1e-9)
    for name, low, high in (("distractor", 3, 6),):
        per = [sum(e.kind == name and e.night == k for e in events) for k in "abc"]
        assert all(low <= p <= high for p in per)
    gaps = sorted((e.night, e.t) for e in events if e.kind == "pulse")
    steps = [b[1] - a[1] for a, b in zip(gaps, gaps[1:]) if a[0] == b[0] and b[1] - a[1] < 10]
    assert steps and min(steps) >= 2.5 * 0.9 - 1e-9 and max(steps) <= 5 * 1.1 + 1e-9


def test_nights_are_the_same_under_any_partitioning(spark, night):
    nights, beds, pulses, distractors = night
    runs = []
    for parts in (1, 7):
        blocks, _ = N.night_blocks(nights.repartition(parts), "night", beds.repartition(parts), pulses.repartition(parts), distractors.repartition(parts), 3, SPEC)
        runs.append({(r.night, r.block): tuple(r.x) for r in blocks.collect()})
    assert runs[0] == runs[1]


def test_sample_streams_are_framed_for_any_cut(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = {f"{k}.raw": rng.integers(-(2**31), 2**31, n, dtype=np.int64).astype("<i4") for k, n in (("one", 300), ("two", 129), ("none", 10))}
    folder = tmp_path / "in"
    folder.mkdir()
    out = None
    for part in range(3):  # the files grow; a block that isn't whole waits
        for name, w in words.items():
            cut = [0, 95, 201, len(w)][part : part + 2]
            with open(folder / name, "ab") as f:
                f.write(w[min(cut[0], len(w)) : min(cut[1], len(w))].tobytes())
        stream = frames.stream_frames(frames.read_word_blocks(spark, str(folder), block=16, rate=16), size=20, late="0 seconds")
        out = stream.schema
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        for _ in range(2):  # the rows, then the timers that the watermark has passed
            q.processAllAvailable()
            time.sleep(2.5)
        q.stop()
    got = {}
    for r in spark.read.schema(out).parquet(str(tmp_path / "out")).collect():
        got.setdefault(os.path.basename(r.path), {})[r.frame] = r.samples
    for name, w in words.items():
        mine = got.get(name, {})
        assert sorted(mine) == list(range(len(mine)))
        for k, x in mine.items():
            assert x == (w[20 * k : 20 * k + 20] >> 16).tolist()
    # what the watermark has passed: all whole frames of the blocks before the last ones
    assert len(got["one.raw"]) >= 13
    df = spark.createDataFrame([(n, k, float(k), w[16 * k : 16 * k + 16].tolist()) for n, w in words.items() for k in range(len(w) // 16)], "path string, seq long, s double, words array<int>")
    batch = frames.batch_frames(df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))), size=20).collect()
    assert {(r.path, r.frame): r.samples for r in batch} == {(n, k): (w[20 * k : 20 * k + 20] >> 16).tolist() for n, w in words.items() for k in range(len(w) // 16 * 16 // 20)}


def test_cache_is_used_while_its_fingerprint_is_the_same(spark, tmp_path):
    folder, place, made = tmp_path / "files", str(tmp_path / "cache"), []
    (folder / "sub").mkdir(parents=True)
    for k in range(3):
        (folder / "sub" / f"{k}.wav").write_bytes(bytes(k + 1))

    def get(config):
        mark = cache.fingerprint(cache.file_table(spark, str(folder), "*.wav"), config)
        return cache.cached(spark, place, mark, lambda: made.append(1) or cache.file_table(spark, str(folder), "*.wav").withColumn("made", F.lit(len(made)))).collect()

    rows = get({"hop": 1})
    assert len(rows) == 3 and {(r.path, r.size) for r in rows} == {(f"sub/{k}.wav", k + 1) for k in range(3)}
    assert get({"hop": 1})[0].made == 1 and len(made) == 1  # unchanged
    assert get({"hop": 2})[0].made == 2  # other settings
    (folder / "other.txt").write_bytes(b"x")
    assert get({"hop": 2})[0].made == 2  # a file that isn't one of the sources
    (folder / "sub" / "1.wav").write_bytes(bytes(9))
    assert get({"hop": 2})[0].made == 3  # a changed file
    os.utime(folder / "sub" / "2.wav", (1, 1))
    assert get({"hop": 2})[0].made == 4  # one with another time
    (folder / "sub" / "0.wav").unlink()
    assert len(get({"hop": 2})) == 2 and len(made) == 5  # one less
    for f in os.listdir(f"{place}/fingerprint"):
        os.remove(f"{place}/fingerprint/{f}")
    assert get({"hop": 2})[0].made == 6  # one that isn't whole


def test_set_hash_is_that_of_a_bag(spark):
    df = spark.createDataFrame([(i % 7, str(i) if i % 3 else None) for i in range(200)], "a int, b string")
    mark = cache.set_hash(df)
    assert mark == cache.set_hash(df.repartition(9).select("b", "a")) and cache.set_hash(df.limit(0)) == cache.set_hash(df.where("a > 100"))
    assert len({mark, cache.set_hash(df.union(df.limit(1))), cache.set_hash(df.where("b <> '5'")), cache.set_hash(df.fillna("", "b"))}) == 4


def test_golden_files(spark, tmp_path):
    rows = [([1, -2, 300], [0.5, -1.25], [3, -128]), ([32767, -32768, 0], [1e-3, 2.0], [127, 0])]
    df = spark.createDataFrame(rows, "x array<int>, features array<double>, q array<int>").coalesce(1)
    golden.write_golden(df, str(tmp_path / "g"), 0.5, -7)
    [name] = [f for f in os.listdir(tmp_path / "g") if f.endswith(golden.SUFFIX)]
    want = struct.pack("<iiifi", 2, 3, 2, 0.5, -7) + b"".join(struct.pack("<3h2f2b", *x, *f, *q) for x, f, q in rows)
    assert (tmp_path / "g" / name).read_bytes() == want
    assert want[:32].hex() == "0200000003000000020000000000003ff9ffffff0100feff2c010000003f0000"
    many = spark.range(2500).selectExpr("array(id % 100, 5) AS x", "array(id / 8) AS features", "array(id % 50) AS q")
    golden.write_golden(many.repartition(3), str(tmp_path / "g"), 0.25, 1, records=400)
    back = golden.read_golden(spark, str(tmp_path / "g"), records=100)
    assert back.count() == 2500 and back.rdd.getNumPartitions() >= 25 and back.select("scale", "zero_point").distinct().collect() == [(0.25, 1)]
    assert back.selectExpr("x[0] AS a", "cast(features[0] * 8 AS int) AS b", "q[0] AS c").where("a <> b % 100 OR c <> b % 50").count() == 0
    golden.write_golden(many.limit(5), str(tmp_path / "g"), 0.25, 1, "append")
    assert golden.read_golden(spark, str(tmp_path / "g")).count() == 2505
    with pytest.raises(Exception, match="different sizes"):
        golden.write_golden(spark.createDataFrame([([1], [1.0], [1]), ([1, 2], [1.0], [1])], df.schema).coalesce(1), str(tmp_path / "bad"), 1.0, 0)
    assert not [f for f in os.listdir(tmp_path / "bad") if f.endswith(golden.SUFFIX)]


def slow_features(x, spec):
    """Sums in place of transforms, for the two specs with frames around multiples of the hop."""
    x = np.concatenate((np.zeros(spec.size // 2), x, np.zeros(spec.size // 2)))
    if spec.whole:
        while (len(x) - spec.size) % spec.hop:
            x = np.append(x, 0.0)
    w = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / spec.size) for i in range(spec.size)])
    w = w / w.sum() if spec.by_window else w
    turn = np.exp(-2j * np.pi * np.outer(np.arange(spec.size // 2 + 1), np.arange(spec.size)) / spec.size)
    power = np.array([np.abs(turn @ (x[a : a + spec.size] * w)) ** 2 for a in range(0, len(x) - spec.size + 1, spec.hop)])
    return power


def test_specs_by_sums():
    rng = np.random.default_rng(8)
    x = np.sin(np.arange(3000) * 0.3) + rng.normal(0, 0.1, 3000)
    # whole bins
    spec = dsp.WHOLE_BINS
    hz = [700 * (10 ** ((2595 * math.log10(1 + 40 / 700) + k * (2595 * math.log10(1 + 6000 / 700) - 2595 * math.log10(1 + 40 / 700)) / 31) / 2595) - 1) for k in range(32)]
    at = [math.floor(256 * f / 8000) for f in hz]
    power, bank = slow_features(x, spec), np.zeros((30, 257))
    for m in range(30):
        a, b, c = at[m : m + 3]
        for k in range(a, b):
            bank[m, k] = (k - a) / (b - a)
        for k in range(b, c):
            bank[m, k] = (c - k) / (c - b)
    want = np.log(power @ bank.T + 1e-6)
    want = (want - want.min()) / (want.max() - want.min() + 1e-8)
    got = dsp.log_mel(x, spec)
    assert got.shape == want.shape == (math.ceil(3000 / 256) + 1, 30) and np.allclose(got, want, atol=1e-6)
    # decibels under the loudest
    spec = dsp.TOP_DB
    low, high = 40 * 3 / 200, 15 + 27 * math.log(6) / math.log(6.4)
    edges = [200 * m / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27) for m in (low + k * (high - low) / 31 for k in range(32))]
    power, bank = slow_features(x, spec), np.zeros((30, 257))
    for m in range(30):
        a, b, c = edges[m : m + 3]
        for k in range(257):
            f = k * 31.25
            bank[m, k] = max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a)
    mel = power @ bank.T
    db = 10 * np.log10(np.maximum(mel, 1e-10)) - 10 * math.log10(mel.max())
    db = np.maximum(db, -80)
    want = (db - db.min()) / (db.max() - db.min() + 1e-8)
    got = dsp.log_mel(x, spec)
    assert got.shape == want.shape == (1 + 3000 // 256, 30) and np.allclose(got, want, atol=1e-6) and got.max() > 0.999
    assert dsp.log_mel(np.zeros(16000), spec).shape == (63, 30) and not dsp.log_mel(np.zeros(16000), spec).any()
    assert dsp.log_mel(np.zeros(0), dsp.WHOLE_BINS).shape[1] == 30


def test_short_beds_are_a_row_a_block(spark, night):
    nights, _, _, _ = night
    x = np.random.default_rng(4).normal(0, 1, 37)
    bed = spark.createDataFrame([(0, x.tolist())], "id long, x array<double>")
    rows = N.beds_of(nights.distinct(), "night", bed, 3, SPEC).collect()
    assert len(rows) == 3 * 12 and sum(len(r.x) for r in rows) <= 37 * len(rows)
    for name in "abc":
        mine = sorted((r for r in rows if r["night"] == name), key=lambda r: r["block"])
        whole = np.concatenate([np.resize(r.x, r.n) for r in mine])
        assert len(whole) == SPEC.samples and abs(np.sqrt(np.mean(whole**2)) - 10**-1.5) < 1e-9
        assert np.abs(whole[37:] - whole[:-37]).max() < 1e-12
