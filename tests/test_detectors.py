"""Detectors, streams, recordings and sinks on known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import dsp
from quillon.operators import episodes as E
from quillon.sources import audio, sinks

SF = "/root/testdata/sf0.001"


def test_episode_known_answers():
    beat = [0.9 if i % 8 < 3 else 0.1 for i in range(40)]
    out, s = E.run_ticks(beat)
    assert [(e["type"], e["tick"]) for e in out] == [("episode_start", 19)] and s["mode"] == "CONFIRMED"
    out, _ = E.run_ticks(beat[:35] + [0.1] * 60)
    end = [e for e in out if e["type"] == "episode_end"]
    assert [(e["tick"], e["n_hits"], e["n_bursts"]) for e in end] == [(76, 15, 5)]
    assert E.run_ticks([0.9] * 400)[0] == []  # continuous sound is not periodic


def test_floor_and_streak():
    s = {}
    assert [E.streak_step(s, x, 5) for x in (True, True, True, False, False)] == [2, 4, 5, 4, 3]
    s = {}
    assert E.floor_step(s, -20.0, E.FloorParams()) == -60.0 and E.floor_step(s, -60.0, E.FloorParams()) == -60.0


def test_stream_is_batch(spark):
    from quillon.plans import library  # noqa: F401
    from quillon.plans.registry import QUERIES

    key = lambda r: (r.user_id, r.type, r.episode_id, r.tick, r.n_hits, None if r.mean_p is None else round(r.mean_p, 9))
    batch = sorted(map(key, QUERIES["episode_fsm"](spark, SF).collect()), key=str)
    stream = sorted(map(key, QUERIES["stream_episode_fsm"](spark, SF).collect()), key=str)
    assert batch and stream == batch


def test_recordings(spark, tmp_path):
    for k, label in enumerate(["pos", "neg"]):
        (tmp_path / label).mkdir()
        (tmp_path / label / "a.wav").write_bytes(audio.encode_wav(np.sin(np.arange(16000) * 0.01 * (k + 1)), 16000))
    (tmp_path / "neg" / "broken.wav").write_bytes(b"RIFF nothing")
    df = audio.read_recordings(spark, [(str(tmp_path), "here"), (str(tmp_path / "absent"), "gone")])
    got = {(r.label_dir, r.error is None): r.samples for r in df.collect()}
    assert set(got) == {("pos", True), ("neg", True), ("neg", False)} and got["neg", False] is None
    assert np.allclose(got["pos", True], np.sin(np.arange(16000) * 0.01), atol=1e-4)
    assert audio.windows_of(df, 8000, 4000, 0.01).groupBy("label_dir").count().orderBy("label_dir").collect()[0]["count"] == 3
    assert audio.errors_of(df).count() == 1
    with pytest.raises(audio.DatasetMissing):
        audio.read_recordings(spark, [(str(tmp_path / "absent"), "gone")])
    with pytest.raises(audio.DatasetMissing):
        audio.require_sources(df, "source", ["here", "gone"])


def test_spectra():
    t = np.arange(16000) / 16000
    spec = dsp.SPEC_1
    mel = dsp.log_mel(np.sin(2 * np.pi * 440 * t), spec)
    assert mel.shape == (61, 30) and np.abs(mel).max() <= 1
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 40 / 700), 2595 * np.log10(1 + 6000 / 700), 32) / 2595) - 1)
    loud = edges[1:-1][mel.mean(0) == 1]  # a tone is so far above the mean that the bands around it are clipped
    assert loud.min() < 440 < loud.max()
    assert abs(edges[1:-1][dsp.log_mel(np.sin(2 * np.pi * 440 * t), dsp.MAGNITUDE).mean(0).argmax()] - 440) < 60
    x = np.random.default_rng(2).normal(size=4000)
    lag, sure = dsp.gcc_phat(x[20:3020], x[13:3013], 16)
    assert abs(lag - 7) < 0.5 and sure > 2
    assert len(dsp.sparse_filterbank(dsp.filterbank(spec))) == 30


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "val").otherwise("train"))
    staged, place = str(tmp_path / "new"), str(tmp_path / "live")
    sinks.write_splits(df, place)
    sinks.write_splits(df.where("id > 4"), staged)
    with pytest.raises(FileNotFoundError):
        sinks.swap(spark, [(staged, place), (str(tmp_path / "absent"), str(tmp_path / "x"))])
    assert spark.read.parquet(place).count() == 10 and spark.read.parquet(staged).count() == 5
    sinks.swap(spark, [(staged, place)])
    assert spark.read.parquet(place).count() == 5
    ledger = sinks.Ledger(str(tmp_path / "ledger.json"))
    assert ledger.claim("m", "a") and not ledger.claim("m", "a") and ledger.claim("m", "b")
    assert len(json.loads((tmp_path / "ledger.json").read_text())) == 2
    report = sinks.pivot_report(df.withColumn("k", F.lit("x")), ["k"], "split", ["train", "val"])
    assert report.splitlines()[-1] == "| x | 7 | 3 |"
