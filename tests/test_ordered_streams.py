"""Machines over streams: any arrival within the watermark's delay gives the batch's rows; timeouts fire without rows; ended keys leave no state."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import episodes as E
from quillon.streaming import ordered as O

DAY = 1_700_000_000
SCHEMA = "key string, us long, a double, b double"
LATE_S = 60


def walk(c, rows, step=E.app_step):
    s, out = {}, []
    for t, detected in rows:
        out += [(x["t"], x["mode"], x["level"], x["n"], x["success"]) for x in step(s, float(t), detected, c)]
    return out


def test_app_goldens():
    c = E.AppParams()
    # a detection every 4 s: raised after more than 10 s, at each one, then stopped after more than 120 s at the raised level
    got = walk(c, [(t, t >= 12 and t % 4 == 0) for t in range(0, 400)])
    assert got[:5] == [(10.0, "MONITOR", 1, 0, None), (12.0, "INTERVENE", 1, 1, None), (24.0, "INTERVENE", 2, 1, None), (28.0, "INTERVENE", 3, 1, None), (136.0, "COOLDOWN", 3, 1, False)]
    assert got[5:7] == [(316.0, "MONITOR", 3, 1, None), (320.0, "INTERVENE", 1, 2, None)]
    # exactly 5 s are no quiet spell, exactly 10 s no reason to rise, exactly 120 s no timeout
    assert walk(c, [(0, False), (10, True), (15, False), (16, False), (75, False), (76, False)]) == [(10.0, "MONITOR", 1, 0, None), (10.0, "INTERVENE", 1, 1, None), (16.0, "COOLDOWN", 1, 1, True), (76.0, "MONITOR", 1, 1, None)]
    assert [x[1:3] for x in walk(c, [(0, False), (10, True), *((t, True) for t in range(12, 21, 2))])][-1] == ("INTERVENE", 1)
    slow = E.AppParams(quiet_s=1000)
    assert walk(slow, [(0, False), (10, True), (130, True)])[-1] == (130.0, "INTERVENE", 2, 1, None)
    assert walk(slow, [(0, False), (10, True), (131, True)])[-1] == (131.0, "COOLDOWN", 2, 1, False)
    # the level rises before the timeout is looked at: three levels of rest
    assert walk(slow, [(0, False), (10, True), (30, True), (131, True), (310, False), (311, False)])[-2:] == [(131.0, "COOLDOWN", 3, 1, False), (311.0, "MONITOR", 3, 1, None)]
    # detections while calibrating or resting change nothing but the time last heard
    assert walk(c, [(0, True), (9, True)]) == []
    spent = walk(E.AppParams(budget=1, rest_s=100), [(0, False), (10, True), (16, False), (80, True), (179, True), (180, True), (279, True), (280, True)])
    assert [x[:2] for x in spent] == [(10.0, "MONITOR"), (10.0, "INTERVENE"), (16.0, "COOLDOWN"), (80.0, "MONITOR"), (179.0, "COOLDOWN"), (279.0, "MONITOR"), (280.0, "COOLDOWN")]


def test_timeouts_come_at_their_own_times():
    run = O.Run(O.app())
    got = []
    for t in (0.0, 20.0, 22.0, 40.0, 500.0):
        got += run.row(t, (True,))
    got += run.until(math.inf, False)
    # calibrated at 10 s, quiet at 27 s, rested at 87 s; the last intervention ends by itself, and so does the night
    assert [(x["t"], x["mode"], x["success"]) for x in got] == [(10.0, "MONITOR", None), (20.0, "INTERVENE", None), (27.0, "COOLDOWN", True), (87.0, "MONITOR", None), (500.0, "INTERVENE", None), (505.0, "COOLDOWN", True), (565.0, "MONITOR", None)]
    assert run.state is None and run.next() is None


APP = E.AppParams(calibrate_s=20, escalate_s=15, timeout_s=90, quiet_s=12, budget=3, rest_s=200, cooldown_s=10)
RULES = E.RuleParams(history=24, duration_min_ms=64, duration_max_ms=2000, period_min_ms=64, period_max_ms=640, confirm=1, ratio_gate=0.2)
MACHINES = {
    "app": (O.app(APP, forget_s=300), ["a"], lambda r: (r.t, r.mode, r.level, r.n, r.success)),
    "rules": (O.rules(RULES, E.FloorParams(start=10.0), forget_s=300), ["a", "b"], lambda r: (round(r.start_ms, 6), round(r.end_ms, 6), r.confidence)),
    "episodes": (O.episodes(E.EpisodeParams(tau=0.6, hold=2, confirm=4, verify=2, min_bursts=2, period_min=2, period_max=8), forget_s=300), ["a", "b"], lambda r: (r.type, r.episode_id, r.tick, r.n_hits)),
}


def rows_of(name, rng):
    out = []
    for key in "xyz":
        t = DAY + rng.random()
        for i in range(160):
            t += rng.choice([0.5, 1, 2, 5, 17]) if rng.random() < 0.97 else 500
            loud = i % 6 < 3
            a, b = {"app": (float(rng.random() < 0.5), 0.0), "rules": (1.0 if i % 30 > 26 else 70.0 + rng.random() if i % 5 == 0 else 40.0, 0.5), "episodes": (0.9 if loud else 0.1, rng.random())}[name]
            out.append((key, round(t * 1e6), a, b))
    return out


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_stream_is_batch_for_any_arrival(spark, tmp_path, name):
    machine, columns, show = MACHINES[name]
    rng = random.Random(len(name))
    rows = rows_of(name, rng)
    frame = lambda rs: spark.createDataFrame(rs, SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    batch = [(r.key, *show(r)) for r in O.run_batch(frame(rows), "key", "ts", columns, machine).collect()]
    assert len(batch) > 10

    # rows arrive up to LATE_S late, in files of 60; then one row far ahead moves the watermark past all, and rows come that are too late
    arriving = sorted(rows, key=lambda r: r[1] + rng.random() * LATE_S * 0.9e6)
    last = max(r[1] for r in rows)
    files = [arriving[k : k + 60] for k in range(0, len(arriving), 60)] + [[("end", last + 10**10, 0.0, 0.0)], [("end", last + 2 * 10**10, 0.0, 0.0)], [("x", DAY * 10**6, 1.0, 1.0), ("end", last + 3 * 10**10, 0.0, 0.0)]]
    source = tmp_path / "in"
    for part in files:  # read in the order in which they were written
        frame(part).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.02)
    stream = spark.readStream.schema(SCHEMA + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = O.run_stream(stream, "key", "ts", columns, machine, f"{LATE_S} seconds")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.key, *show(r)) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("key <> 'end'").collect()]
    assert sorted(got, key=str) == sorted(batch, key=str)
    left = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "value").load()
    assert {r[0] for r in left.select("key.key").collect()} <= {"end"}


def test_waiting_rows_are_kept_in_packs(spark, tmp_path):
    machine, columns, _ = MACHINES["rules"]
    rows = [("x", (DAY + i) * 10**6, 40.0, 0.5) for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA + ", ts timestamp").parquet(str(tmp_path / "in"))
    out = O.run_stream(stream, "key", "ts", columns, machine, "1 day")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 1 <= spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "waiting").load().count() < 5
