"""Payloads, deployments, chunks of recordings, skipped features and thresholds on known answers."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import features, metrics
from quillon.sources import sinks, wav


def test_payload_of_an_episode(spark):
    df = spark.createDataFrame([("d1", 1700000000.9, 12.345, 1.7, 4, -31.26, "left", 0.12345, 0.9876, False, 3.0), ("d2", 5.0, 0.04, -0.2, None, None, None, None, None, None, None)], "device_id string, ts double, duration_s double, mean_p double, n_bursts int, level_dbfs double, side string, lag_ms double, doa_conf double, presence boolean, motion double")
    a, b = (r.asDict() for r in sinks.cloud_events(df, "2.1").collect())
    assert a == {"device_id": "d1", "timestamp": 1700000000, "event_type": "snore_detected", "snore_duration_sec": 12.3, "snore_confidence": 1.0, "in_bed": False, "body_motion_level": 1.0, "model_version": "2.1", "note": a["note"]}
    assert json.loads(a["note"]) == {"side": "left", "lag_ms": 0.123, "doa_conf": 0.988, "n_bursts": 4, "level_dbfs": -31.3} and " " not in a["note"]
    assert (b["snore_confidence"], b["in_bed"], b["body_motion_level"]) == (0.0, True, 0.0) and json.loads(b["note"]) == {"side": "unknown", "lag_ms": 0.0, "doa_conf": 0.0, "n_bursts": 0, "level_dbfs": 0.0}
    bare = sinks.cloud_events(df.select("device_id", "ts", "duration_s", "mean_p"), "2.1").collect()
    assert json.loads(bare[0].note)["side"] == "unknown"
    with pytest.raises(ValueError):
        sinks.cloud_events(df, "Demo-1")
    with pytest.raises(Exception, match="exceeds"):
        sinks.cloud_events(df.withColumn("side", F.repeat(F.lit("x"), 1000)), "2.1").collect()


def test_deployed_generation_is_bound_to_its_model(spark, tmp_path):
    model, place = tmp_path / "model.bin", str(tmp_path / "live")
    for k in range(2):
        model.write_bytes(bytes([k]) * 100)
        sinks.deploy(spark, place, str(model), {"auc": k}, {"tau": 0.5})
        bound = json.loads(open(f"{place}/threshold.json").read())
        assert bound == {"tau": 0.5, "model_sha256": hashlib.sha256(open(f"{place}/model.bin", "rb").read()).hexdigest()}
        assert json.loads(open(f"{place}/metrics.json").read()) == {"auc": k} and not os.path.exists(place + ".new") and not os.path.exists(place + ".old")
    with pytest.raises(FileNotFoundError):
        sinks.deploy(spark, place, str(tmp_path / "absent"), {}, {})
    assert json.loads(open(f"{place}/metrics.json").read()) == {"auc": 1}


def test_chunks_roll_at_their_size(spark, tmp_path):
    x = {k: np.sin(np.arange(n) / 5) * 0.5 for k, n in (("a", 2500), ("b", 1000), ("c", 30))}
    rng = np.random.default_rng(1)
    blocks = []
    for k, v in x.items():
        cuts = [0, *sorted(rng.choice(np.arange(1, len(v)), 5, replace=False).tolist()), len(v)]
        blocks += [(k, a, v[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
    blocks.append(("c", 30, []))
    df = spark.createDataFrame(blocks, "key string, first long, samples array<double>").repartition(4)
    out = sorted((r.key, r.chunk, r.n, r.path) for r in sinks.write_chunks(df, str(tmp_path / "out"), 8000, 1000).collect())
    assert [r[:3] for r in out] == [("a", 0, 1000), ("a", 1, 1000), ("a", 2, 500), ("b", 0, 1000), ("c", 0, 30)]
    for k, c, n, path in out:
        w = wav.of_bytes(open(path, "rb").read(), 8000)
        assert np.allclose(w.samples(), x[k][1000 * c : 1000 * c + n], atol=1e-4)
    assert sorted(os.listdir(tmp_path / "out" / "a")) == ["chunk_0000.wav", "chunk_0001.wav", "chunk_0002.wav"]


def test_features_of_another_shape_are_skipped(spark):
    sizes = {"a": [16000, 16000, 15800], "b": [100, None]}
    rows = [(k, None if n is None else [0.01 * (i % 7) for i in range(n)]) for k, v in sizes.items() for n in v]
    out = features.feature_rows(spark.createDataFrame(rows, "label string, x array<double>"), "x", 61)
    assert {tuple(r) for r in features.skip_counts(out, "label").collect()} == {("a", 3, 2, 1), ("b", 2, 0, 2)}


def test_threshold_to_deploy(spark):
    sweep = spark.createDataFrame([(0.3, 0.05, 0.5), (0.4, 0.1, 0.2), (0.5, 0.3, 0.1), (0.55, 0.05, 0.05)], "threshold double, fnr double, fpr double")
    pick = lambda fnr, fpr, a, b: metrics.deploy_threshold(sweep, fnr, fpr, a, b).first().threshold
    assert pick(0.15, 0.15, [0.3, 0.4, 0.5], [0.3, 0.55]) == 0.4 and pick(0.15, 0.15, [0.5], [0.3, 0.55]) == 0.55 and pick(0.01, 0.01, [0.5], [0.3]) == 0.5
