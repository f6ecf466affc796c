"""Events and episodes matched by islands against a plain loop; running extremes by blocks of time."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import matching as J

EVENTS, EPISODES = "key string, event_id long, t double", "key string, episode long, start_s double, end_s double"


def plain(events, episodes, tolerance):
    out = {}
    for key in {e[0] for e in events}:
        spans = sorted(((s, j, e) for k, j, s, e in episodes if k == key and s is not None and e is not None), key=lambda x: x[:2])
        used = set()
        for _, i, t in sorted((e for e in events if e[0] == key and e[2] is not None), key=lambda e: (e[2], e[1])):
            found = next((j for s, j, e in spans if j not in used and s - tolerance <= t <= e + tolerance), None) if key is not None else None
            used.add(found)
            out[key, i] = found
        out |= {(key, i): None for k, i, t in events if k == key and t is None}
    return out


@pytest.mark.parametrize("width", [7.0, 60.0, 1e9])
def test_matches_equal_a_plain_loop(spark, width):
    rng = random.Random(int(width))
    events = [(rng.choice("abc"), i, float(rng.randint(0, 900)) / 2) for i in range(400)] + [("a", 1000, None), (None, 1001, 5.0), ("only events", 1002, 3.0)]
    episodes = []
    for j in range(150):
        start = rng.randint(0, 420)
        episodes.append((rng.choice("abc"), j, float(start), float(start + rng.choice([0, 1, 3, 3, 60]))))
    episodes += [("a", 900, None, 5.0), (None, 901, 0.0, 9.0), ("only episodes", 902, 1.0, 2.0), ("b", 903, 50.0, 40.0)]
    for tolerance in (0.0, 2.5):
        got = J.match_events(spark.createDataFrame(events, EVENTS), spark.createDataFrame(episodes, EPISODES), "key", tolerance, width)
        assert {(r.key, r.event_id): r.episode for r in got.collect()} == plain(events, episodes, tolerance)


def test_one_key_with_most_events(spark):
    n = 100_000
    events = spark.range(n).select(F.lit("hot").alias("key"), F.col("id").alias("event_id"), (F.col("id") * 3.0).alias("t"))
    episodes = spark.range(n // 2).select(F.lit("hot").alias("key"), F.col("id").alias("episode"), (F.col("id") * 6.0 + 1).alias("start_s"), (F.col("id") * 6.0 + 4).alias("end_s"))
    rows = J.islands(events, episodes, "key", 0.5, 600.0)
    # no window or group holds more than a block of the key
    assert rows.where("island IS NOT NULL").groupBy("island").count().agg(F.max("count")).first()[0] <= 2
    got = J.match_events(events, episodes, "key", 0.5, 600.0)
    assert got.count() == n and got.where("episode IS NOT NULL").count() == n // 2
    assert got.where("episode IS NOT NULL AND event_id <> 2 * episode + 1").count() == 0


def test_first_after_over_blocks(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randint(0, 300) / 2) for _ in range(200)] + [(None, 1.0)]
    right = [(rng.choice("abc"), rng.randint(0, 280) / 2) for _ in range(60)] + [("a", None), (None, 2.0)]
    df = lambda rows: spark.createDataFrame(rows, "key string, t double")
    for width in (1.0, 13.0, 1e6):
        got = J.first_after(df(left), df(right), "key", "t", "to", width).collect()
        want = [(k, t, min((u for j, u in right if j == k and u is not None and u >= t), default=None) if k else None) for k, t in left]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_night_scores(spark):
    events = spark.createDataFrame([("n", 1, 12.0), ("n", 2, 49.0), ("n", 3, 500.0), ("m", 4, 1.0)], EVENTS)
    episodes = spark.createDataFrame([("n", 1, 10.0, 30.0), ("n", 2, 50.0, 60.0), ("n", 3, 900.0, 950.0), ("k", 4, 1.0, 2.0)], EPISODES)
    stops = spark.createDataFrame([("n", 11.0), ("n", 33.5), ("n", 55.0)], "key string, t double")
    ends = spark.createDataFrame([("n", 1, 45.0), ("n", 2, 58.0)], "key string, event_id long, end_t double")
    matches = J.match_events(events, episodes, "key", 5.0)
    got = {r.key: r for r in J.night_scores(matches, episodes, "key", 2.0, stops, ends).collect()}
    n = got["n"]
    # an event before its episode has no latency below 0; an early stop no stop latency below 0
    assert (n.episodes, n.matched, n.false_events, n.false_per_hour) == (3, 2, 1, 0.5) and abs(n.detection_rate - 2 / 3) < 1e-9
    assert (n.latency_mean, round(n.latency_p90, 9)) == (1.0, 1.8) and (n.stop_latency_mean, round(n.stop_latency_p90, 9)) == (1.75, 3.15) and n.end_delay_mean == 7.5
    assert got["m"].false_events == 1 and got["m"].latency_mean is None and got["k"].detection_rate == 0
