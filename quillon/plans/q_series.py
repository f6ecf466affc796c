"""Queries on series: a user's events in time order; the value is the level, and value / 100 (at most 1) the probability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import episodes as E
from quillon.operators import matching as J
from quillon.operators import windowing as W
from quillon.plans.q_metrics import r6
from quillon.plans.registry import query, table

T = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick FROM events)"


def ticks(spark, d):
    return W.ticked(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), "user_id", ["ts", "event_id"])


@query("sliding_windows", f"WITH {T}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), w AS (SELECT user_id, unnest(range(0, greatest(n - 16, -1) + 1, 8)) AS start FROM n) SELECT w.user_id, w.start // 8 AS window, w.start, round(avg(value), 6) AS mean, max(value) AS peak FROM w JOIN e ON e.user_id = w.user_id AND e.tick >= w.start AND e.tick < w.start + 16 GROUP BY ALL")
def sliding_windows(spark, d):
    return r6(W.sliding(ticks(spark, d), "user_id", "tick", 16, 8, [F.avg("value").alias("mean"), F.max("value").alias("peak")]))


@query("tumbling_windows", f"WITH {T} SELECT user_id, tick // 16 AS window, min(tick) AS start, round(avg(value), 6) AS mean FROM e GROUP BY user_id, tick // 16 HAVING count(*) = 16")
def tumbling_windows(spark, d):
    return r6(W.tumbling(ticks(spark, d), "user_id", "tick", 16, [F.avg("value").alias("mean")]))


@query("time_windows", "WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts + INTERVAL 12 HOUR) - INTERVAL 12 HOUR]) AS s FROM events) SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def time_windows(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("frame_ring", f"WITH {T} SELECT event_id, user_id, tick, round(m, 6) AS ring_mean FROM (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick ROWS 15 PRECEDING)) WHERE n = 16")
def frame_ring(spark, d):
    return r6(W.ring(ticks(spark, d), "user_id", "tick", "value", 16).select("event_id", "user_id", "tick", "ring_mean"))


@query("strict_peaks", f"WITH {T} SELECT event_id, user_id, tick, value FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lead(value, 1) OVER w AS c, lead(value, 2) OVER w AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick)) WHERE value > m * 1.2 AND value > a AND value > b AND value > c AND value > d")
def strict_peaks(spark, d):
    return W.strict_peaks(ticks(spark, d), "user_id", "tick", "value", 1.2).select("event_id", "user_id", "tick", "value")


@query("peak_intervals", f"WITH {T}, p AS (SELECT user_id, tick FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lead(value, 1) OVER w AS c, lead(value, 2) OVER w AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick)) WHERE value > m * 1.2 AND value > a AND value > b AND value > c AND value > d), g AS (SELECT *, tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick) AS gap FROM p) SELECT user_id, tick, gap, gap BETWEEN 3 AND 14 AS periodic FROM g WHERE gap IS NOT NULL")
def peak_intervals(spark, d):
    return W.peak_intervals(strict_peaks(spark, d).select("user_id", "tick"), "user_id", "tick", 3, 14)


PEAKS = f"{T}, q AS (SELECT user_id, quantile_cont(value, 0.6) AS q FROM e GROUP BY 1), p AS (SELECT e.*, lag(value) OVER w AS a, lead(value) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick)), c AS (SELECT p.user_id, tick, value FROM p JOIN q ON p.user_id = q.user_id WHERE value >= q AND value > coalesce(a, '-inf'::DOUBLE) AND value >= coalesce(b, '-inf'::DOUBLE))"


@query("local_peaks", f"WITH {PEAKS} SELECT user_id, tick, value FROM c")
def local_peaks(spark, d):
    return W.peaks_over(ticks(spark, d), "user_id", "tick", "value", 0.6).select("user_id", "tick", "value")


@query("topk_separated_peaks", f"WITH {PEAKS}, l AS (SELECT user_id, list([tick] ORDER BY value DESC, tick) AS l FROM c GROUP BY 1), k AS (SELECT user_id, list_reduce(l, lambda acc, x: CASE WHEN len(acc) < 5 AND len(list_filter(acc, lambda t: abs(t - x[1]) < 4)) = 0 THEN list_concat(acc, x) ELSE acc END) AS k FROM l) SELECT user_id, (unnest(range(len(k))))::INT AS place, unnest(k) AS tick FROM k")
def topk_separated_peaks(spark, d):
    return W.separated(local_peaks(spark, d), "user_id", "tick", "value", 5, 4)


@query("loudest_window", f"WITH {T}, w AS (SELECT user_id, tick // 8 AS w, round(sqrt(avg(value * value)), 6) AS rms FROM e GROUP BY ALL HAVING count(*) = 8) SELECT user_id, arg_max(w, {{'r': rms, 'w': -w}}) AS \"window\", max(rms) AS rms FROM w GROUP BY user_id")
def loudest_window(spark, d):
    w = W.tumbling(ticks(spark, d), "user_id", "tick", 8, [F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms")])
    return W.loudest_window(w, "user_id", "rms", "window")


@query("rolling_hold_max", f"WITH {T} SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY tick ROWS 12 PRECEDING) AS activity FROM e")
def rolling_hold_max(spark, d):
    t = ticks(spark, d)
    return t.select("event_id", W.hold_max(t, "user_id", "tick", "value", 12).alias("activity"))


B = f"{T}, b AS (SELECT user_id, tick FROM (SELECT *, value >= 60 AS hit, coalesce(lag(value >= 60) OVER (PARTITION BY user_id ORDER BY tick), false) AS before FROM e) WHERE hit AND NOT before)"


@query("burst_starts", f"WITH {B} SELECT * FROM b")
def burst_starts(spark, d):
    return W.bursts(ticks(spark, d), "user_id", "tick", F.col("value") >= 60).select("user_id", "tick")


@query("burst_gap_median", f"WITH {B}, w AS (SELECT user_id, tick, list_sort(list(tick) OVER (PARTITION BY user_id ORDER BY tick RANGE 32 PRECEDING)) AS l FROM b), g AS (SELECT *, list_sort(list_transform(range(1, len(l)), lambda i: l[i + 1] - l[i])) AS g FROM w) SELECT user_id, tick, len(l)::INT AS n_bursts, g[(len(g) + 1) // 2] AS median_gap FROM g")
def burst_gap_median(spark, d):
    return W.burst_gaps(burst_starts(spark, d), "user_id", "tick", 32)


SPANS = f"{T}, s AS (SELECT user_id, tick AS start_s, tick + (value / 10)::INT AS end_s FROM e WHERE event_type = 'purchase')"


def spans(spark, d):
    """Purchases as spans: from their tick on, one for each ten of their value."""
    t = ticks(spark, d).where("event_type = 'purchase'")
    return t.select("user_id", F.col("tick").alias("start_s"), (F.col("tick") + F.bround(F.col("value") / 10).cast("int")).alias("end_s"))


@query("span_overlaps", f"WITH {SPANS.replace('(value / 10)::INT', 'round_even(value / 10, 0)::INT')} SELECT user_id, start_s, end_s, n AS next_start FROM (SELECT *, lead(start_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s) AS n FROM s) WHERE n < end_s")
def span_overlaps(spark, d):
    return W.overlaps(spans(spark, d), "user_id", "start_s", "end_s").select("user_id", "start_s", "end_s", "next_start")


@query("slice_spans", f"WITH {SPANS.replace('(value / 10)::INT', 'round_even(value / 10, 0)::INT')} SELECT user_id, start_s, k::INT AS k, (start_s + k)::DOUBLE AS offset_s FROM (SELECT *, unnest(range(0, greatest(end_s - start_s, 0))) AS k FROM s)")
def slice_spans(spark, d):
    return W.slice_spans(spans(spark, d), "start_s", "end_s").select("user_id", "start_s", "k", "offset_s")


@query("reframe", f"WITH {T} SELECT user_id, tick // 5 AS frame, count(*) AS n, max(tick % 5) AS last FROM e GROUP BY ALL")
def reframe(spark, d):
    return W.reframed(ticks(spark, d), "user_id", "tick", 5).groupBy("user_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))


@query("gated_noise_floor", f"""WITH RECURSIVE {T}, f AS (SELECT user_id, tick, event_id, CASE WHEN value < 30.0 + 5 THEN 0.98::DOUBLE * 30 + 0.02::DOUBLE * value ELSE 30.0::DOUBLE END AS floor FROM e WHERE tick = 0
UNION ALL SELECT e.user_id, e.tick, e.event_id, CASE WHEN e.value < f.floor + 5 THEN 0.98::DOUBLE * f.floor + 0.02::DOUBLE * e.value ELSE f.floor END FROM f JOIN e ON e.user_id = f.user_id AND e.tick = f.tick + 1)
SELECT user_id, event_id, round(floor + 1e-9::DOUBLE, 6) AS floor FROM f""")
def gated_noise_floor(spark, d):
    c = E.FloorParams(start=30.0)
    step = lambda s, r: [{"event_id": r[0], "floor": round(E.floor_step(s, float(r[1]), c) + 1e-9, 6)}]
    return E.fold(ticks(spark, d), "user_id", ["tick"], step, dict, "event_id long, floor double", ["event_id", "value"])


@query("clamped_streak", f"""WITH RECURSIVE {T}, f AS (SELECT user_id, tick, event_id, CASE WHEN value >= 50 THEN 2 ELSE 0 END AS streak FROM e WHERE tick = 0
UNION ALL SELECT e.user_id, e.tick, e.event_id, CASE WHEN e.value >= 50 THEN least(f.streak + 2, 20) ELSE greatest(0, f.streak - 1) END FROM f JOIN e ON e.user_id = f.user_id AND e.tick = f.tick + 1)
SELECT user_id, event_id, streak FROM f""")
def clamped_streak(spark, d):
    step = lambda s, r: [{"event_id": r[0], "streak": E.streak_step(s, float(r[1]) >= 50, 20)}]
    return E.fold(ticks(spark, d), "user_id", ["tick"], step, dict, "event_id long, streak int", ["event_id", "value"])


@query("coherent_noise_floor", f"""WITH RECURSIVE {T}, f AS (SELECT user_id, tick, event_id, value AS floor FROM e WHERE tick = 0
UNION ALL SELECT e.user_id, e.tick, e.event_id, CASE WHEN e.value < f.floor THEN f.floor + 0.2::DOUBLE * (e.value - f.floor) WHEN e.event_type <> 'purchase' THEN f.floor + 0.005::DOUBLE * (e.value - f.floor) ELSE f.floor END FROM f JOIN e ON e.user_id = f.user_id AND e.tick = f.tick + 1)
SELECT user_id, event_id, round(floor + 1e-9::DOUBLE, 6) AS floor FROM f""")
def coherent_noise_floor(spark, d):
    step = lambda s, r: [{"event_id": r[0], "floor": round(E.coherent_floor_step(s, float(r[1]), r[2] == "purchase") + 1e-9, 6)}]
    return E.fold(ticks(spark, d), "user_id", ["tick"], step, dict, "event_id long, floor double", ["event_id", "value", "event_type"])


#: Scaled to series of 50 to 90 ticks, so that episodes both begin and end.
EPISODES = E.EpisodeParams(tau=0.6, hold=2, confirm=4, verify=2, min_bursts=2, period_min=2, period_max=8)


#: State by tick, from a tick before the first: o is what a tick emits.
EPISODE_FSM = f"""
WITH RECURSIVE {T}, b AS (SELECT user_id, tick, least(value / 100, 1.0::DOUBLE) AS p, value AS l FROM e),
s AS (
  SELECT DISTINCT user_id, -1::BIGINT AS tick, 'IDLE' AS mode, []::DOUBLE[] AS ps, []::BIGINT[] AS bursts, []::STRUCT(i BIGINT, p DOUBLE, l DOUBLE)[] AS hits, false AS in_burst,
    0::BIGINT AS streak, 0::BIGINT AS below, 0::BIGINT AS episode, 0::BIGINT AS start, 0::BIGINT AS n, 0::DOUBLE AS total, 0::BIGINT AS last, 0::DOUBLE AS levels, 0::BIGINT AS n_bursts, ''::VARCHAR AS said
  FROM b
  UNION ALL
  SELECT user_id, i, CASE WHEN ends THEN 'IDLE' WHEN confirmed THEN 'CONFIRMED' WHEN mode = 'ACTIVE' AND streak = 0 THEN 'IDLE' ELSE mode END, ps,
    CASE WHEN ends THEN [] ELSE bursts END, CASE WHEN ends THEN [] ELSE hits END, hit AND NOT ends, CASE WHEN ends THEN 0 ELSE streak END, CASE WHEN ends OR confirmed THEN 0 ELSE below END,
    CASE WHEN confirmed THEN episode + 1 ELSE episode END, CASE WHEN confirmed THEN bursts[1] ELSE start END,
    CASE WHEN confirmed THEN len(own) ELSE n END, CASE WHEN confirmed THEN list_sum([x.p for x in own]) ELSE total END, CASE WHEN confirmed THEN own[-1].i ELSE last END,
    CASE WHEN confirmed THEN list_sum([x.l for x in own]) ELSE levels END, CASE WHEN confirmed THEN len(bursts) ELSE n_bursts END,
    CASE WHEN ends THEN 'episode_end' WHEN confirmed THEN 'episode_start' ELSE '' END
  FROM (SELECT *, mode = 'CONFIRMED' AND below >= {EPISODES.verify} AS ends, list_filter(hits, lambda x: x.i >= bursts[1]) AS own,
      mode = 'ACTIVE' AND streak > 0 AND streak >= {2 * EPISODES.confirm} AND len(bursts) >= {max(2, EPISODES.min_bursts)}
        AND list_sort(list_transform(range(1, len(bursts)), lambda k: bursts[k + 1] - bursts[k]))[(len(bursts) - 2) // 2 + 1] BETWEEN {EPISODES.period_min} AND {EPISODES.period_max} AS confirmed
    FROM (SELECT user_id, i, ps, hit, streak, episode, start,
        CASE WHEN mode = 'IDLE' AND active THEN 'ACTIVE' ELSE mode END AS mode,
        list_filter(CASE WHEN hit AND NOT in_burst THEN bursts || [i] ELSE bursts END, lambda t: t >= i - {EPISODES.confirm + EPISODES.hold}) AS bursts,
        list_filter(CASE WHEN hit THEN hits || [{{'i': i, 'p': p, 'l': l}}] ELSE hits END, lambda x: x.i >= i - {EPISODES.confirm + EPISODES.hold}) AS hits,
        CASE WHEN mode = 'CONFIRMED' AND active THEN 0 WHEN mode = 'CONFIRMED' THEN below + 1 ELSE below END AS below,
        CASE WHEN mode = 'CONFIRMED' AND hit THEN n + 1 ELSE n END AS n, CASE WHEN mode = 'CONFIRMED' AND hit THEN total + p ELSE total END AS total,
        CASE WHEN mode = 'CONFIRMED' AND hit THEN i ELSE last END AS last, CASE WHEN mode = 'CONFIRMED' AND hit THEN levels + l ELSE levels END AS levels,
        CASE WHEN mode = 'CONFIRMED' AND hit AND NOT in_burst THEN n_bursts + 1 ELSE n_bursts END AS n_bursts
      FROM (SELECT *, list_max(ps) >= {EPISODES.tau} AS active, CASE WHEN list_max(ps) >= {EPISODES.tau} THEN least(before + 2, {4 * EPISODES.confirm}) ELSE greatest(0, before - 1) END AS streak
        FROM (SELECT s.* EXCLUDE (tick, ps, streak, said), s.streak AS before, b.tick AS i, b.p, b.l, b.p >= {EPISODES.tau} AS hit, (s.ps || [b.p])[-{EPISODES.hold + 1}:] AS ps
          FROM s JOIN b ON b.user_id = s.user_id AND b.tick = s.tick + 1))))
)
SELECT user_id, said AS type, episode::INT AS episode_id, tick, CASE WHEN said = 'episode_start' THEN start ELSE tick END * 0.5::DOUBLE AS t, n_bursts::INT AS n_bursts,
  CASE WHEN said = 'episode_end' THEN start * 0.5::DOUBLE END AS start_t, CASE WHEN said = 'episode_end' THEN (last - start + 2) * 0.5::DOUBLE END AS duration_s,
  CASE WHEN said = 'episode_end' THEN round(total / greatest(n, 1) + 1e-9::DOUBLE, 4) END AS mean_p, CASE WHEN said = 'episode_end' THEN n::INT END AS n_hits,
  CASE WHEN said = 'episode_end' THEN round(levels / greatest(n, 1) + 1e-9::DOUBLE, 4) END AS level_dbfs, (tick + 2) * 0.5::DOUBLE AS t_end
FROM s WHERE said <> ''
"""


@query("episode_fsm", EPISODE_FSM)
def episode_fsm(spark, d):
    t = ticks(spark, d).withColumn("p", F.least(F.col("value") / 100, F.lit(1.0)))
    out = E.episodes(t, "user_id", "tick", "p", "value", EPISODES).withColumn("t_end", E.tick_end(F.col("tick")))
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("mean_p", "level_dbfs")})


RULES = E.RuleParams(history=24, duration_min_ms=64, duration_max_ms=2000, period_min_ms=64, period_max_ms=640, confirm=1, ratio_gate=0.2)
RULE_FLOOR = E.FloorParams(start=10.0)
_LOW, _HIGH = max(1, int(RULES.period_min_ms / RULES.frame_ms)), min(int(RULES.period_max_ms / RULES.frame_ms), RULES.history - 1)
#: State by frame, from a frame before the first. The ring's slots are counted from 1 here.
RULE_FRAMES = f"""
WITH RECURSIVE {T}, b AS (SELECT user_id, tick, event_id, value AS l, ((json_extract_string(props, '$.k')::INT % 100) / 100.0::DOUBLE) AS ratio FROM e),
s AS (
  SELECT DISTINCT user_id, -1::BIGINT AS tick, -1::BIGINT AS event_id, {RULE_FLOOR.start}::DOUBLE AS floor, 0 AS mode, 0::DOUBLE AS clock, 0::DOUBLE AS start, list_transform(range({RULES.history}), lambda k: {RULES.unheard}::DOUBLE) AS ring,
    0::BIGINT AS slot, false AS hit, 0::DOUBLE AS confidence FROM b
  UNION ALL
  SELECT user_id, tick, event_id, floor, CASE WHEN NOT heard THEN 0 WHEN mode = 0 THEN 1 WHEN mode = 1 THEN CASE WHEN sure THEN 2 WHEN length > {RULES.duration_max_ms} THEN 0 ELSE 1 END ELSE CASE WHEN length > {RULES.duration_max_ms} THEN 0 ELSE 2 END END,
    clock, CASE WHEN heard AND mode = 0 THEN clock ELSE start END, ring, slot, heard AND (mode = 2 OR mode = 1 AND sure),
    CASE WHEN heard AND mode = 2 THEN 0.85::DOUBLE WHEN heard AND mode = 1 AND sure THEN 0.7::DOUBLE + (ratio - 0.55::DOUBLE) * 0.5::DOUBLE ELSE 0 END
  FROM (SELECT *, length > {RULES.duration_min_ms} AND length < {RULES.duration_max_ms} AND len(list_filter(range(1, len(peaks)), lambda k: peaks[k + 1] - peaks[k] BETWEEN {_LOW} AND {_HIGH})) >= {RULES.confirm} AS sure
    FROM (SELECT *, clock - start AS length, list_filter(range(3, {RULES.history} - 1), lambda k: ring[k] > list_sum(ring) / {RULES.history} * {RULES.peak_factor}::DOUBLE AND ring[k] > greatest(ring[k - 2], ring[k - 1], ring[k + 1], ring[k + 2])) AS peaks
      FROM (SELECT user_id, tick, event_id, floor, mode, start, ratio, heard, CASE WHEN heard THEN clock + {RULES.frame_ms} ELSE clock END AS clock,
          CASE WHEN heard THEN ring[1:slot] || [l] || ring[slot + 2:] ELSE ring END AS ring, CASE WHEN heard THEN (slot + 1) % {RULES.history} ELSE slot END AS slot
        FROM (SELECT *, l - floor >= {RULES.energy_gate} AND ratio >= {RULES.ratio_gate}::DOUBLE AS heard
          FROM (SELECT s.* EXCLUDE (tick, event_id, floor, hit, confidence), b.tick, b.event_id, b.l, b.ratio,
              CASE WHEN b.l < s.floor + {RULE_FLOOR.margin} THEN (1 - {RULE_FLOOR.alpha}::DOUBLE) * s.floor + {RULE_FLOOR.alpha}::DOUBLE * b.l ELSE s.floor END AS floor
            FROM s JOIN b ON b.user_id = s.user_id AND b.tick = s.tick + 1)))))
)
"""


def rule_frames(spark, d):
    """Each user's events as frames: value is the level, the number in props the band ratio in per cent."""
    rows = ticks(spark, d).join(table(spark, d, "events").select("event_id", "props"), "event_id")
    return rows.withColumn("ratio", F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(100)) / 100)


@query("rule_detector", RULE_FRAMES + "SELECT user_id, event_id, mode, hit, round(confidence, 6) AS confidence, clock AS clock_ms, round(floor, 6) AS noise_floor FROM s WHERE tick >= 0")
def rule_detector(spark, d):
    step = lambda s, r: [{"event_id": r[0]} | E.rule_step(s, float(r[1]), float(r[2]), RULES, RULE_FLOOR)]
    out = E.fold(rule_frames(spark, d), "user_id", ["tick"], step, dict, "event_id long, " + E.RULE_FIELDS, ["event_id", "value", "ratio"])
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "noise_floor")})


@query("rule_events", RULE_FRAMES + """, x AS (SELECT *, lag(mode) OVER w AS was, lag(start) OVER w AS began, row_number() OVER (PARTITION BY user_id ORDER BY tick DESC) AS back FROM s WINDOW w AS (PARTITION BY user_id ORDER BY tick))
SELECT user_id, began AS start_ms, clock AS end_ms, CASE WHEN hit THEN 0.85::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM x WHERE was = 2 AND mode = 0
UNION ALL SELECT user_id, start, clock, 0.8::DOUBLE FROM x WHERE back = 1 AND mode = 2""")
def rule_events(spark, d):
    """The events of rule_detector, those that are open at a user's end included."""

    def step(s, r):
        E.rule_step(s, float(r[0]), float(r[1]), RULES, RULE_FLOOR)
        return []

    end = lambda s: [{"start_ms": a, "end_ms": b, "confidence": c} for a, b, c in E.rule_flush(s)]
    return E.fold(rule_frames(spark, d), "user_id", ["tick"], step, dict, "start_ms double, end_ms double, confidence double", ["value", "ratio"], end)


APP = E.AppParams(calibrate_s=3600, escalate_s=7200, timeout_s=86400, quiet_s=43200, budget=3, rest_s=172800, cooldown_s=3600)
#: A row's state after each of the four things that a tick does; out holds what it emits, in order.
APP_MODES = f"""
WITH RECURSIVE {T}, b AS (SELECT user_id, tick, epoch(ts)::DOUBLE AS t, value >= 80 AS det FROM e),
s AS (
  SELECT user_id, tick, 'CALIBRATE' AS mode, t AS since, 1 AS level, 0 AS n, t AS heard, t AS until, []::STRUCT(t DOUBLE, mode VARCHAR, level INT, n INT, success BOOLEAN)[] AS out
  FROM b WHERE tick = 0
  UNION ALL
  SELECT user_id, tick, CASE WHEN quiet THEN 'COOLDOWN' ELSE mode END, CASE WHEN quiet THEN t ELSE since END, level, n, heard,
    CASE WHEN quiet THEN t + {APP.cooldown_s} * level ELSE until END,
    out || CASE WHEN quiet THEN [{{'t': t, 'mode': 'COOLDOWN', 'level': level, 'n': n, 'success': true}}] ELSE [] END
  FROM (SELECT *, mode = 'INTERVENE' AND t - heard > {APP.quiet_s} AS quiet FROM (
    SELECT user_id, tick, t, CASE WHEN rested THEN 'MONITOR' ELSE mode END AS mode, CASE WHEN rested THEN t ELSE since END AS since, level, n, heard, until,
      out || CASE WHEN rested THEN [{{'t': t, 'mode': 'MONITOR', 'level': level, 'n': n, 'success': NULL}}] ELSE [] END AS out
    FROM (SELECT *, mode = 'COOLDOWN' AND t >= until AS rested FROM (
      SELECT user_id, tick, t, CASE WHEN spent OR late THEN 'COOLDOWN' WHEN begins THEN 'INTERVENE' ELSE mode END AS mode, CASE WHEN spent OR late OR begins THEN t ELSE since END AS since,
        level2 AS level, n2 AS n, CASE WHEN det THEN t ELSE heard END AS heard,
        CASE WHEN spent THEN t + {APP.rest_s} WHEN late THEN t + {APP.cooldown_s} * level2 ELSE until END AS until,
        out || CASE WHEN spent THEN [{{'t': t, 'mode': 'COOLDOWN', 'level': level2, 'n': n2, 'success': NULL}}] WHEN begins OR level2 > level THEN [{{'t': t, 'mode': 'INTERVENE', 'level': level2, 'n': n2, 'success': NULL}}] ELSE [] END
          || CASE WHEN late THEN [{{'t': t, 'mode': 'COOLDOWN', 'level': level2, 'n': n2, 'success': false}}] ELSE [] END AS out
      FROM (SELECT *, det AND mode = 'MONITOR' AND n >= {APP.budget} AS spent, det AND mode = 'MONITOR' AND n < {APP.budget} AS begins, det AND mode = 'INTERVENE' AND t - since > {APP.timeout_s} AS late,
          CASE WHEN det AND mode = 'MONITOR' AND n < {APP.budget} THEN 1 WHEN det AND mode = 'INTERVENE' AND t - since > {APP.escalate_s} AND level < {APP.top_level} THEN level + 1 ELSE level END AS level2,
          CASE WHEN det AND mode = 'MONITOR' AND n < {APP.budget} THEN n + 1 ELSE n END AS n2
        FROM (SELECT user_id, tick, t, det, CASE WHEN ready THEN 'MONITOR' ELSE mode END AS mode, CASE WHEN ready THEN t ELSE since END AS since, level, n, heard, until,
            CASE WHEN ready THEN [{{'t': t, 'mode': 'MONITOR', 'level': level, 'n': n, 'success': NULL}}] ELSE [] END AS out
          FROM (SELECT b.*, mode, since, level, n, heard, until, s.mode = 'CALIBRATE' AND b.t - s.since >= {APP.calibrate_s} AS ready FROM s JOIN b ON b.user_id = s.user_id AND b.tick = s.tick + 1))))))))
SELECT user_id, o.t AS t, o.mode AS mode, o.level AS level, o.n AS n, o.success AS success FROM (SELECT user_id, unnest(out) AS o FROM s)
"""


@query("app_modes", APP_MODES)
def app_modes(spark, d):
    step = lambda s, r: E.app_step(s, float(r[0]), float(r[1]) >= 80, APP)
    rows = ticks(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return E.fold(rows, "user_id", ["tick"], step, dict, E.APP_FIELDS, ["t", "value"])


HOURS = 24 * 30
EV = "v AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t, event_type, value FROM events), ep AS (SELECT user_id, event_id AS episode, t AS start_s, t + value * 600 AS end_s FROM v WHERE event_type = 'purchase'), ev AS (SELECT user_id, event_id, t FROM v WHERE event_type = 'click')"


def seconds(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), "event_type", "value").withColumn("t", F.col("us") / 1e6).drop("us")


def matched(spark, d):
    v = seconds(spark, d)
    ep = v.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("episode"), F.col("t").alias("start_s"), (F.col("t") + F.col("value") * 600).alias("end_s"))
    return v.where("event_type = 'click'").select("user_id", "event_id", "t"), ep


MATCH = f"{EV}, c AS (SELECT ev.user_id, ev.event_id, ev.t, list(ep.episode ORDER BY ep.start_s, ep.episode) FILTER (WHERE ep.episode IS NOT NULL) AS c FROM ev LEFT JOIN ep ON ev.user_id = ep.user_id AND ev.t BETWEEN start_s - 5 AND end_s + 5 GROUP BY ALL), o AS (SELECT user_id, list(event_id ORDER BY t, event_id) AS ids, list(t ORDER BY t, event_id) AS ts, list(coalesce(c, []::BIGINT[]) ORDER BY t, event_id) AS cs FROM c GROUP BY 1), m AS (SELECT user_id, ids, ts, list_reduce(list_prepend([]::BIGINT[], cs), lambda acc, x: list_append(acc, coalesce(list_filter(x, lambda y: NOT list_contains(acc, y))[1], -1))) AS m FROM o), r AS (SELECT user_id, unnest(ids) AS event_id, unnest(ts) AS t, nullif(unnest(m), -1) AS episode FROM m)"


@query("interval_event_matching", f"WITH {MATCH} SELECT user_id, event_id, t, episode FROM r")
def interval_event_matching(spark, d):
    ev, ep = matched(spark, d)
    return J.match_events(ev, ep, "user_id", 5.0)


NIGHT_SCORES = f"""
WITH {MATCH}, q AS (SELECT user_id, t FROM v WHERE value < 40), f AS (SELECT user_id, t FROM v WHERE event_type = 'error'),
x AS (SELECT r.*, ep.start_s, ep.end_s, (SELECT min(q.t) FROM q WHERE q.user_id = r.user_id AND q.t >= r.t) AS stop_t, (SELECT min(f.t) FROM f WHERE f.user_id = r.user_id AND f.t >= r.t) AS end_t
  FROM r LEFT JOIN ep ON r.user_id = ep.user_id AND r.episode = ep.episode),
y AS (SELECT user_id, episode, CASE WHEN episode IS NOT NULL THEN greatest(0, t - start_s) END AS latency, CASE WHEN episode IS NOT NULL AND stop_t IS NOT NULL THEN greatest(0, stop_t - end_s) END AS stop_latency,
  CASE WHEN episode IS NOT NULL AND end_t IS NOT NULL THEN greatest(0, end_t - end_s) END AS end_delay FROM x),
a AS (SELECT user_id, count(episode) AS matched, count(*) FILTER (WHERE episode IS NULL) AS false_events, avg(latency) AS lm, quantile_cont(latency, 0.9) AS lp,
  avg(stop_latency) AS sm, quantile_cont(stop_latency, 0.9) AS sp, avg(end_delay) AS em FROM y GROUP BY 1),
b AS (SELECT user_id, count(*) AS episodes FROM ep GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(episodes, 0) AS episodes, coalesce(matched, 0) AS matched, coalesce(false_events, 0) AS false_events,
  round(lm, 3) AS latency_mean, round(lp, 3) AS latency_p90, round(sm, 3) AS stop_latency_mean, round(sp, 3) AS stop_latency_p90, round(em, 3) AS end_delay_mean,
  round(coalesce(matched, 0) / greatest(coalesce(episodes, 0), 1)::DOUBLE, 6) AS detection_rate, round(coalesce(false_events, 0) / {HOURS}.0::DOUBLE, 6) AS false_per_hour
FROM b FULL JOIN a ON a.user_id = b.user_id
"""


@query("night_scores", NIGHT_SCORES)
def night_scores(spark, d):
    """Clicks as detections of purchases; values under 40 are ticks without activity, the next error ends what a click began."""
    ev, ep = matched(spark, d)
    v = seconds(spark, d)
    ends = J.first_after(ev, v.where("event_type = 'error'").select("user_id", "t"), "user_id", "t", "end_t").where("end_t IS NOT NULL")
    s = J.night_scores(J.match_events(ev, ep, "user_id", 5.0), ep, "user_id", HOURS, v.where("value < 40").select("user_id", "t"), ends)
    rounded = [F.round(c, 3).alias(c) for c in ("latency_mean", "latency_p90", "stop_latency_mean", "stop_latency_p90", "end_delay_mean")]
    return s.select("user_id", "episodes", "matched", "false_events", *rounded, F.round("detection_rate", 6).alias("detection_rate"), F.round("false_per_hour", 6).alias("false_per_hour"))


@query("first_after", f"WITH {EV} SELECT ev.user_id, ev.event_id, ev.t, min(p.start_s) AS next_t FROM ev LEFT JOIN ep p ON p.user_id = ev.user_id AND p.start_s >= ev.t GROUP BY ALL")
def first_after(spark, d):
    ev, ep = matched(spark, d)
    return J.first_after(ev, ep.select("user_id", F.col("start_s").alias("t")), "user_id", "t", "next_t").select("user_id", "event_id", "t", "next_t")


@query("pair_start_end", f"WITH {EV} SELECT ep.user_id, ep.episode, ep.start_s, x.end_t FROM ep LEFT JOIN (SELECT user_id, max(t) AS end_t FROM v WHERE event_type = 'error' GROUP BY 1) x ON ep.user_id = x.user_id")
def pair_start_end(spark, d):
    _, ep = matched(spark, d)
    ends = seconds(spark, d).where("event_type = 'error'").select("user_id", "t")
    return J.pair_start_end(ep.select("user_id", "episode", "start_s"), ends, ["user_id"], "t")


@query("outside_spans", f"WITH {EV} SELECT user_id, event_id, t FROM ev WHERE NOT EXISTS (SELECT 1 FROM ep WHERE ep.user_id = ev.user_id AND ev.t BETWEEN start_s - 2 AND end_s + 2)")
def outside_spans(spark, d):
    ev, ep = matched(spark, d)
    return J.outside(ev, ep, "user_id", "t", "start_s", "end_s", 2.0, 3600.0)


@query("lag_histogram_median", f"WITH h AS (SELECT user_id, floor(value / 5)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY bin) AS through, sum(n) OVER (PARTITION BY user_id) AS total FROM h) SELECT user_id, min(bin) * 5.0::DOUBLE AS median_low, any_value(total)::BIGINT AS n FROM c WHERE 2 * through >= total GROUP BY 1")
def lag_histogram_median(spark, d):
    """The lower median from a histogram: counts by bin, then the first bin that reaches half."""
    h = table(spark, d, "events").groupBy("user_id", F.floor(F.col("value") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id")
    c = h.withColumn("through", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return c.where(2 * F.col("through") >= F.col("total")).groupBy("user_id").agg((F.min("bin") * 5.0).alias("median_low"), F.first("total").alias("n"))


SIDE = "CASE WHEN value - 35 > 20 THEN 'left' WHEN value - 35 < -20 THEN 'right' ELSE 'unknown' END"


@query("both_sides", f"WITH s AS (SELECT user_id, {SIDE} AS side FROM events), n AS (SELECT user_id, count(*) FILTER (WHERE side = 'left') AS l, count(*) FILTER (WHERE side = 'right') AS r, count(*) AS n FROM s GROUP BY 1) SELECT user_id, l AS n_left, r AS n_right, l + r > 0 AND least(l, r) >= 0.25::DOUBLE * (l + r) AND (l + r) >= 0.7::DOUBLE * n AS both_sides FROM n")
def both_sides(spark, d):
    from quillon.functions import arrays as A

    s = table(spark, d, "events").withColumn("side", A.side(F.col("value") - 35, 20.0))
    n = s.groupBy("user_id").agg(F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right"), F.count(F.lit(1)).alias("n"))
    known = F.col("n_left") + F.col("n_right")
    return n.select("user_id", "n_left", "n_right", ((known > 0) & (F.least("n_left", "n_right") >= 0.25 * known) & (known >= 0.7 * F.col("n"))).alias("both_sides"))


@query("direction_grid", f"WITH g AS (SELECT a, b FROM (SELECT unnest([10, 20]) AS a), (SELECT unnest([30, 50]) AS b)), x AS (SELECT g.a, g.b, CASE WHEN value - b > a THEN 'left' WHEN value - b < -a THEN 'right' ELSE 'unknown' END AS side, event_type FROM events, g) SELECT a::INT AS dead, b::INT AS centre, count(*) AS n, round(avg((side = 'unknown')::INT), 6) AS unknown, round(avg((side = 'left')::INT), 6) AS accuracy FROM x GROUP BY ALL")
def direction_grid(spark, d):
    cells = [(a, b) for a in (10, 20) for b in (30, 50)]
    grid = F.array(*[F.struct(F.lit(a).alias("dead"), F.lit(b).alias("centre")) for a, b in cells])
    rows = table(spark, d, "events").select("value", F.inline(grid))
    lag = F.col("value") - F.col("centre")
    side = F.when(lag > F.col("dead"), "left").when(lag < -F.col("dead"), "right").otherwise("unknown")
    return r6(rows.withColumn("side", side).groupBy("dead", "centre").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("side") == "unknown").cast("int")).alias("unknown"), F.avg((F.col("side") == "left").cast("int")).alias("accuracy")))


@query("cascade_filter", "SELECT event_id, value FROM events WHERE value >= 60 AND event_type IN ('click', 'purchase') AND (ln(value + 1) / ln(10)) > 1.9")
def cascade_filter(spark, d):
    """The cheap predicates reach the scan; the costly one runs on what is left."""
    e = table(spark, d, "events").select("event_id", "value", "event_type")
    return e.where((F.col("value") >= 60) & F.col("event_type").isin("click", "purchase")).where(F.log10(F.col("value") + 1) > 1.9).select("event_id", "value")


CLOUD = """
SELECT event_id, device_id, epoch(ts)::BIGINT - CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END AS timestamp, 'snore_detected' AS event_type, round(value * 1.7::DOUBLE + 1e-9::DOUBLE, 1) AS snore_duration_sec,
  round(greatest(0, least(1, value / 100 + 1e-9::DOUBLE)), 3) AS snore_confidence, event_type <> 'error' AS in_bed, greatest(0, least(1, (value - 50) / 100)) AS body_motion_level, '2.1' AS model_version,
  CASE WHEN value >= 120 THEN 'left' WHEN value >= 60 THEN 'right' ELSE 'unknown' END AS side, round(value / 7 + 1e-9::DOUBLE, 3) AS lag_ms, 0.0::DOUBLE AS doa_conf, k AS n_bursts, round(value / 3 - 90 - 1e-9::DOUBLE, 1) AS level_dbfs
FROM (SELECT *, 'user-' || user_id AS device_id, json_extract_string(props, '$.k')::INT AS k FROM events)
"""


@query("cloud_events", CLOUD)
def cloud_events(spark, d):
    """Events as episodes: all fields of their payloads, those of the note read back from its JSON."""
    from quillon.sources import sinks

    v, e = F.col("value"), table(spark, d, "events")
    rows = e.select(
        F.concat_ws("\x1f", F.concat(F.lit("user-"), F.col("user_id")), "event_id").alias("device_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (v * 1.7 + 1e-9).alias("duration_s"),
        (v / 100 + 1e-9).alias("mean_p"), (F.col("event_type") != "error").alias("presence"), ((v - 50) / 100).alias("motion"), F.when(v >= 120, "left").when(v >= 60, "right").alias("side"),
        (v / 7 + 1e-9).alias("lag_ms"), F.get_json_object("props", "$.k").cast("int").alias("n_bursts"), (v / 3 - 90 - 1e-9).alias("level_dbfs"),
    )
    note = F.from_json("note", "side string, lag_ms double, doa_conf double, n_bursts int, level_dbfs double")
    out = sinks.cloud_events(rows, "2.1").withColumn("note", note)
    id = F.split("device_id", "\x1f")  # the event's id rides on the device's, to tell rows apart
    return out.select(id[1].cast("long").alias("event_id"), id[0].alias("device_id"), *[c for c in out.columns if c not in ("device_id", "note")], "note.*")
