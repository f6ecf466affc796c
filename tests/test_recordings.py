"""Recordings: resampling against direct sums, reads by byte range, seven differently ruled sources against a plain loop."""

import csv
import io
import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import resample as R
from quillon.functions.hashing import uniform
from quillon.sources import audio, wav, windows


def direct(x, own, rate, n):
    """Output n of the windowed sinc by its definition."""
    up, down = R.ratio(own, rate)
    cut, t = min(1.0, up / down), n * down / up
    total = weight = 0.0
    for k in range(math.floor(t) - 200, math.floor(t) + 201):
        u = abs(t - k) * cut / R.ZEROS
        if u < 1:
            h = np.sinc(cut * (t - k)) * (0.42 + 0.5 * math.cos(math.pi * u) + 0.08 * math.cos(2 * math.pi * u))
            weight += h
            total += h * (x[k] if 0 <= k < len(x) else 0.0)
    return total / weight


@pytest.mark.parametrize("own", [44100, 48000, 22050, 8000, 11025])
def test_resampling_is_the_direct_sum(own):
    x = np.random.default_rng(own).normal(size=700)
    y = R.resample(x, own, 16000)
    assert len(y) == math.ceil(len(x) * 16000 / own)
    for n in (0, 1, 7, len(y) // 2, len(y) - 1):
        assert abs(y[n] - direct(x, own, 16000, n)) < 1e-9
    first, m = len(y) // 3, 50
    a, b = R.needed(first, m, own, 16000)
    a, b = max(0, a), min(len(x), b)
    assert np.allclose(R.resample(x[a:b], own, 16000, first, m, a), y[first : first + m], atol=1e-12)


def test_tones_above_half_the_new_rate_are_gone():
    t = np.arange(44100) / 44100
    level = {f: np.sqrt((R.resample(np.sin(2 * np.pi * f * t), 44100, 16000)[2000:-2000] ** 2).mean()) for f in (440, 6500, 9000, 15000)}
    assert abs(level[440] - 0.5**0.5) < 1e-3 and abs(level[6500] - 0.5**0.5) < 1e-3 and level[9000] < 1e-3 and level[15000] < 1e-4
    assert len(R.resample(np.zeros(0), 44100, 16000)) == 0


def test_spectrum_resampling():
    t = np.arange(1000) / 1000
    for n in (1600, 1601, 640, 641):
        got = R.fft_resample(np.sin(2 * np.pi * 50 * t) + 0.3, n)
        assert np.allclose(got, np.sin(2 * np.pi * 50 * np.arange(n) / n) + 0.3, atol=1e-9)
    x = np.random.default_rng(1).normal(size=9)
    spectrum = np.array([sum(x[j] * np.exp(-2j * np.pi * j * k / 9) for j in range(9)) for k in range(-4, 5)])
    want = [sum(spectrum[k + 4] * np.exp(2j * np.pi * k * m / 15) for k in range(-4, 5)).real / 9 for m in range(15)]
    assert np.allclose(R.fft_resample(x, 15), want)


def test_resampled_column(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [])], "id int, x array<double>")
    got = {r.id: r.y for r in df.select("id", R.resampled("x", 3, 2).alias("y")).collect()}
    assert got[2] is None and got[3] == [] and np.allclose(got[1], R.resample(np.array([1.0, 2, 3]), 3, 2))


def encoded(x, rate, bits=16, kind=1, channels=1, extra=b""):
    """A WAV file of any format; x in [-1, 1), one row a channel or a single series."""
    x = np.repeat(np.atleast_2d(x), channels if np.ndim(x) == 1 else 1, 0).T.ravel()
    if kind == 3:
        raw = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        raw = np.round(x * 127 + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        raw = b"".join(int(v).to_bytes(3, "little", signed=True) for v in np.round(x * (2**23 - 1)))
    else:
        raw = np.round(x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + extra + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_formats():
    x = np.sin(np.arange(400) / 9) * 0.7
    for bits, kind, near in ((8, 1, 0.02), (16, 1, 1e-4), (24, 1, 1e-6), (32, 1, 1e-6), (32, 3, 1e-6), (64, 3, 1e-12)):
        data = encoded(x, 16000, bits, kind, 2, extra=b"LIST\x05\x00\x00\x00abcde\x00")
        w = wav.of_bytes(data)
        assert w.n == 400 and np.allclose(w.samples(), x, atol=near)
        assert np.allclose(w.samples(390, 30), np.concatenate((x[390:], np.zeros(20))), atol=near)
    for bad in (b"", b"RIFF nothing", encoded(x, 16000, 16, 7), b"RIFF\x00\x00\x00\x00WAVE"):
        with pytest.raises(ValueError):
            wav.of_bytes(bad)


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


@pytest.mark.parametrize("rate", [16000, 44100])
def test_one_window_is_read_without_the_rest(rate):
    x = np.random.default_rng(3).uniform(-0.5, 0.5, rate * 60)
    f = Counted(encoded(x, rate))
    w = wav.Wav(f, len(f.getvalue()))
    whole = wav.of_bytes(f.getvalue()).samples()
    part = w.samples(400_000, 16_000)
    assert f.read_bytes < 2 * (rate + 1000) and np.allclose(part, whole[400_000:416_000], atol=1e-12)


RULES = [
    windows.SourceRule("lab_s", r"lab/s[^/]*/[^/]*\.wav", "1", "concat('lab_', split(stem, '-')[0], '_', stem)", "split(stem, '-')[0]", "peaks", "3", apart_s=1.5),
    windows.SourceRule("lab_e", r"lab/e[^/]*/[^/]*\.wav", "0", "concat('lab_', split(stem, '-')[0], '_', stem)", "split(stem, '-')[0]", "loudest", "2"),
    windows.SourceRule("folds", r"folds/audio/[^/]*\.wav", "int(category = 'target')", "concat('fold', fold)", "category", "peaks", "if(label = 1, 3, 2)", apart_s=1.0, lookup="folds/meta.csv"),
    windows.SourceRule("street", r"street/[^/]*\.wav", "0", "concat('street_', stem)", "split(stem, '_')[0]", "stride", "4", stride_s=0.7),
    windows.SourceRule("pairs", r"pairs/(?:yes|no)/[^/]*\.wav", "int(folder = 'yes')", "concat('pairs_', stem)", "folder"),
    windows.SourceRule("named", r"named/[^/]*\.wav", "int(file LIKE '%\\_s\\_%')", "concat('named_', stem)", "if(file LIKE '%\\_s\\_%', 'yes', 'no')"),
    windows.SourceRule("wild", r"wild/deep/yes[^/]*\.wav", "1", "concat('wild_', stem)", "'yes'"),
]


def recording(rng, seconds, rate):
    x = rng.normal(0, 0.01, int(seconds * rate))
    for _ in range(rng.integers(1, 6)):
        a = rng.integers(0, len(x))
        x[a : a + rate // 5] += rng.normal(0, 0.2, len(x[a : a + rate // 5]))
    return np.clip(x, -0.99, 0.99)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("recordings"), np.random.default_rng(11)
    names = [f"lab/s{k}/{k}-a.wav" for k in range(3)] + [f"lab/e{k}/{k}-b.wav" for k in range(3)] + [f"folds/audio/{k}.wav" for k in range(4)]
    names += [f"street/car_{k}.wav" for k in range(2)] + ["pairs/yes/1.wav", "pairs/no/2.wav", "named/a_s_1.wav", "named/b_n_2.wav", "wild/deep/yes1.wav", "wild/deep/other.wav", "elsewhere/x.wav"]
    for k, n in enumerate(names):
        (at / n).parent.mkdir(parents=True, exist_ok=True)
        rate = (16000, 22050, 44100)[k % 3]
        (at / n).write_bytes(encoded(recording(rng, (0.4, 2.5, 5)[k % 5 % 3], rate), rate, channels=1 + k % 2))
    (at / "named/broken_s_.wav").write_bytes(b"RIFF....")
    (at / "named/quiet_s_.wav").write_bytes(encoded(np.zeros(20000), 16000))
    with open(at / "folds/meta.csv", "w", newline="") as f:
        csv.writer(f).writerows([["filename", "fold", "category"], ["0.wav", "1", "target"], ["1.wav", "2", "rain"], ["2.wav", "3", "target"]])
    return at


def plain_windows(at, draws):
    """(source, path, offset, label, group, category) by a loop over files and frames."""
    meta = {r["filename"]: r for r in csv.DictReader(open(at / "folds/meta.csv"))}
    out = set()
    for root, _, files in os.walk(at):
        for name in files:
            path = os.path.relpath(os.path.join(root, name), at)
            top, parent, stem = path.split("/")[0], path.split("/")[-2], name.rsplit(".", 1)[0]
            if not name.endswith(".wav") or top == "elsewhere" or path.endswith("other.wav") or "broken" in name or "quiet" in name:
                continue
            if top == "folds" and name not in meta:
                continue
            x = wav.of_bytes((at / path).read_bytes()).samples()
            n, size = len(x), 16000
            levels = [20 * math.log10(math.sqrt(sum(v * v for v in x[i : i + 512]) / 512) + 1e-9) for i in range(0, n - 511, 512)]
            around = lambda i: min(max(i * 512 + 256 - 8000, 0), max(0, n - size))

            def peaks(most, apart):
                limit, got = np.percentile(levels, 60), []
                for i in sorted((i for i in range(1, len(levels) - 1) if levels[i] >= limit and levels[i] > levels[i - 1] and levels[i] >= levels[i + 1]), key=lambda i: -levels[i]):
                    if len(got) < most and all(abs(i - j) * 512 >= apart * 16000 for j in got):
                        got.append(i)
                return [around(i) for i in got]

            batch = stem.split("-")[0]
            if top == "lab":
                s = parent.startswith("s")
                offsets = peaks(3, 1.5) if s else [around(levels.index(max(levels))), min(max(0, n - size), int(draws[path] * (max(0, n - size) + 1)))]
                row = ("lab_s" if s else "lab_e", int(s), f"lab_{batch}_{stem}", batch)
            elif top == "folds":
                target = meta[name]["category"] == "target"
                offsets, row = peaks(3 if target else 2, 1.0), ("folds", int(target), f"fold{meta[name]['fold']}", meta[name]["category"])
            elif top == "street":
                offsets, row = list(range(0, max(1, n - size + 1), 11200))[:4], ("street", 0, f"street_{stem}", "car")
            else:
                label = {"pairs": parent == "yes", "named": "_s_" in name, "wild": True}[top]
                offsets, row = [max(0, n - size) // 2], (top, int(label), f"{top}_{stem}", parent if top == "pairs" else "yes" if label else "no")
            out |= {(row[0], path, o, *row[1:]) for o in offsets}
    return out


def test_seven_sources_equal_a_plain_loop(spark, folder):
    df = windows.source_windows(spark, str(folder), windows.rules_of(windows.rules_table(spark, RULES)), seed=5).cache()
    paths = spark.createDataFrame([(os.path.relpath(os.path.join(r, f), folder),) for r, _, fs in os.walk(folder) for f in fs], "path string")
    draws = {r.path: r.u for r in paths.select("path", uniform(5, F.col("path")).alias("u")).collect()}
    got = df.where("error IS NULL").collect()
    assert {(r.source, r.path, r.offset, r.label, r.group, r.category) for r in got} == plain_windows(folder, draws)
    assert len({r.source for r in got}) == 7 and all(len(r.x) == 16000 for r in got)
    assert [r.path for r in df.where("error IS NOT NULL").collect()] == ["named/broken_s_.wav"]
    again = wav.load_windows(df.where("error IS NULL").withColumnRenamed("x", "was"), str(folder))
    assert again.columns[-2:] == ["error", "x"] or set(again.columns) == {*df.columns, "was"}
    for r in again.collect():
        assert np.allclose(r.x, r.was, atol=1e-9)
    with pytest.raises(audio.DatasetMissing):
        windows.source_windows(spark, str(folder / "absent"), RULES)
    with pytest.raises(ValueError):
        windows.SourceRule("x", "x", "1", "x", "x", "middle")


def test_windows_of_missing_files(spark, folder):
    df = spark.createDataFrame([("street/car_0.wav", 100), ("absent.wav", 0), (None, 0), ("street/car_0.wav", None), ("street/car_0.wav", 10**9)], "path string, offset long")
    got = {(r.path, r.offset): r.x for r in wav.load_windows(df, str(folder), size=50).collect()}
    assert [k for k, x in got.items() if x is not None and any(x)] == [("street/car_0.wav", 100)]
    assert got["street/car_0.wav", 10**9] == [0.0] * 50 and got["absent.wav", 0] is None and got[None, 0] is None


def test_data_source_of_windows(spark, folder):
    df = wav.read_wav_windows(spark, str(folder / "street"), hop=4000, split_mb=0.05)
    rows = {(os.path.basename(r.path), r.offset): r.x for r in df.where("error IS NULL").collect()}
    want = {}
    for k in range(2):
        w = wav.of_bytes((folder / f"street/car_{k}.wav").read_bytes())
        want |= {(f"car_{k}.wav", o): w.samples(o, 16000) for o in range(0, max(1, w.n - 16000 + 1), 4000)}
    assert rows.keys() == want.keys() and all(np.allclose(rows[k], want[k]) for k in want)
    assert df.rdd.getNumPartitions() > 3  # files are split by bytes
    one = df.where((F.col("path") == str(folder / "street/car_0.wav")) & (F.col("offset") == 8000))
    assert one.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    assert [len(r.x) for r in one.collect()] == [16000 if ("car_0.wav", 8000) in want else 0][: one.count()]
    assert {r.offset for r in df.where("offset >= 4000 AND offset < 12000").collect()} == {o for _, o in want if 4000 <= o < 12000}
    assert wav.read_wav_windows(spark, str(folder / "absent")).count() == 0
    assert wav.read_wav_windows(spark, str(folder / "named")).where("error IS NOT NULL").count() == 1


def test_left_channel_and_fitted_recordings(spark, tmp_path):
    x = np.stack([np.full(3000, 0.25), np.full(3000, -0.75)])
    data = encoded(x, 8000, channels=2)
    assert np.allclose(audio.decode_wav(data, 8000, channel="left"), 0.25, atol=1e-4) and np.allclose(audio.decode_wav(data, 8000), -0.25, atol=1e-4)
    assert [len(audio.decode_wav(data, 16000, m)) for m in audio.METHODS] == [6000] * 3
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "b.wav").write_bytes(encoded(np.arange(100) / 200, 8000))
    got = {os.path.basename(r.path): r.samples for r in audio.read_recordings(spark, [(str(tmp_path), "s")], 8000, size=1000).collect()}
    assert len(got["a.wav"]) == 1000 and got["b.wav"][100:] == [0.0] * 900 and abs(got["b.wav"][99] - 0.495) < 1e-3
    strict = audio.read_recordings(spark, [(str(tmp_path), "s")], 16000, strict_rate=True)
    assert {r.error for r in audio.errors_of(strict).collect()} == {"ValueError: rate 8000"}
