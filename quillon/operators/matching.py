"""Matching detected events with labelled intervals, and what is scored from it."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.episodes import fold


#: Seconds of a block of time; a task holds a key's rows of one block.
BLOCK_S = 86_400.0


def running(rows: DataFrame, key: str, at: str, order: list[str], to: str, how: str, value: Column, through: bool = True, back: bool = False, width: float = BLOCK_S) -> DataFrame:
    """Add a running extreme (how: min or max) of a value over each key's rows in time order, the row itself among them or not. back: over the rows after it.

    Rows are cut into blocks of time, and each block begins with the extreme of the blocks before it, so that a key's rows needn't meet in one
    task. Rows without a key or time are left out."""
    over, both = {"min": (F.min, F.least), "max": (F.max, F.greatest)}[how]
    turn = F.desc if back else F.asc
    rows = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumns({"__b": F.floor(F.col(at) / width), "__v": value})
    blocks = rows.groupBy(key, "__b").agg(over("__v").alias("__v"))
    before = Window.partitionBy(key).orderBy(turn("__b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "__b", over("__v").over(before).alias("__carried"))
    inside = Window.partitionBy(key, "__b").orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    # greatest() and least() pass over nulls
    return rows.join(blocks, [key, "__b"]).withColumn(to, both("__carried", over("__v").over(inside))).drop("__b", "__v", "__carried")


def islands(events: DataFrame, episodes: DataFrame, key: str, tolerance: float, width: float = BLOCK_S) -> DataFrame:
    """Events, and episodes widened by tolerance, as rows in time: key, at, kind (0: episode, 1: event), start_s, open_to, episode, event_id, t, island.

    An island is a stretch in which some episode is open all the time, named by its first moment. Events outside have none."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    spans = episodes.select(key, (F.col("start_s") - tolerance).alias("at"), F.lit(0).alias("kind"), "start_s", (F.col("end_s") + tolerance).alias("open_to"), "episode", none(events, "event_id").alias("event_id"), none(events, "t").alias("t"))
    points = events.select(key, F.col("t").alias("at"), F.lit(1).alias("kind"), none(episodes, "start_s").alias("start_s"), none(episodes, "end_s").alias("open_to"), none(episodes, "episode").alias("episode"), "event_id", "t")
    order = ["at", "kind", "start_s", "episode", "event_id"]
    rows = running(spans.where(F.col("open_to") >= F.col("at")).unionByName(points), key, "at", order, "reach", "max", F.col("open_to"), through=False, width=width)
    open_before = F.coalesce(F.col("reach") >= F.col("at"), F.lit(False))
    begins = F.when((F.col("kind") == 0) & ~open_before, F.col("at"))
    rows = running(rows, key, "at", order, "island", "max", begins, width=width)
    return rows.withColumn("island", F.when((F.col("kind") == 0) | open_before, F.col("island"))).drop("reach")


def _take(s: dict, row: tuple) -> list[dict]:
    """An episode opens, or an event takes the first open one; one that has closed can't be taken by later events."""
    at, kind, start, open_to, episode, event_id, t = row
    waiting = s.setdefault("open", [])
    if kind == 0:
        heapq.heappush(waiting, (start, episode, open_to))
        return []
    while waiting and waiting[0][2] < at:
        heapq.heappop(waiting)
    return [{"event_id": event_id, "t": t, "episode": heapq.heappop(waiting)[1] if waiting else None}]


def match_events(events: DataFrame, episodes: DataFrame, key: str, tolerance: float, width: float = BLOCK_S) -> DataFrame:
    """Each event with the episode it matches (null: none): in time order an event takes the first episode (by start, then episode) not yet taken
    whose span, widened by tolerance, holds its time. events: key, event_id, t; episodes: key, episode, start_s, end_s.

    Time is cut into islands where no episode is open; events outside have no match. Islands are matched apart from each other, each in one pass that holds its open
    episodes only, so that neither a long night nor a key with most events is gathered. Events without key or time match nothing."""
    rows = islands(events, episodes, key, tolerance, width)
    columns = [key, "event_id", "t", "episode"]
    inside = rows.where("island IS NOT NULL").withColumn("__in", F.struct(F.col(key).alias("key"), "island"))
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("event_id", events), ("t", events), ("episode", episodes)))
    found = fold(inside, "__in", ["at", "kind", "start_s", "episode", "event_id"], _take, dict, schema, ["at", "kind", "start_s", "open_to", "episode", "event_id", "t"])
    none = F.lit(None).cast(episodes.schema["episode"].dataType).alias("episode")
    outside = rows.where("island IS NULL").select(key, "event_id", "t", none)
    lost = events.where(F.col(key).isNull() | F.col("t").isNull()).select(key, "event_id", "t", none)
    return found.select(F.col("__in.key").alias(key), *columns[1:]).unionByName(outside).unionByName(lost)


def night_scores(matches: DataFrame, episodes: DataFrame, key: str, hours: float, stops: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """By key: episodes, matched, detection_rate, latency mean and p90, false confirms an hour; with stops (key, t: the end of each tick without activity) mean and p90 of the
    stop latency, from an episode's end to the first such tick at or after its event; with ends (key, event_id, end_t: when what an event began
    was over) the mean delay of ends. Latencies and delays count from 0 up; events whose episode has no such tick or end are left out of them."""
    m = matches.join(episodes.select(key, "episode", "start_s", "end_s"), [key, "episode"], "left")
    measures = {"latency": F.greatest(F.col("t") - F.col("start_s"), F.lit(0.0))}
    if stops is not None:
        m = first_after(m, stops.select(key, "t"), key, "t", "stop_t")
        measures["stop_latency"] = F.greatest(F.col("stop_t") - F.col("end_s"), F.lit(0.0))
    if ends is not None:
        m = m.join(ends.select(key, "event_id", "end_t"), [key, "event_id"], "left")
        measures["end_delay"] = F.greatest(F.col("end_t") - F.col("end_s"), F.lit(0.0))
    # greatest() passes over nulls, so what has none of the two times is told here
    known = {"latency": "start_s", "stop_latency": "stop_t", "end_delay": "end_t"}
    measures = {n: F.when(F.col("episode").isNotNull() & F.col(known[n]).isNotNull(), x) for n, x in measures.items()}
    aggs = [F.count("episode").alias("matched"), F.count_if(F.col("episode").isNull()).alias("false_events")]
    for n, x in measures.items():
        aggs += [F.avg(x).alias(f"{n}_mean"), F.percentile(x, F.lit(0.9)).alias(f"{n}_p90")]
    a = m.groupBy(key).agg(*aggs)
    b = episodes.groupBy(key).agg(F.count(F.lit(1)).alias("episodes"))
    out = b.join(a, key, "full").na.fill(0, ["episodes", "matched", "false_events"])
    return out.withColumn("detection_rate", F.col("matched") / F.greatest("episodes", F.lit(1))).withColumn("false_per_hour", F.col("false_events") / hours)


def pair_start_end(starts: DataFrame, ends: DataFrame, key: list[str], t: str) -> DataFrame:
    """Each start with its key's last end (null if there is none)."""
    last = ends.groupBy(*key).agg(F.max(t).alias("end_t"))
    return starts.join(last, key, "left")


def first_after(left: DataFrame, right: DataFrame, key: str, t: str, to: str, width: float = BLOCK_S) -> DataFrame:
    """Each left row with the first right row at or after its time (null: none): one pass over both sides in time order, by blocks of time; no range join."""
    kind = right.schema[t].dataType
    both = left.select(key, t, F.lit(None).cast(kind).alias("__r"), F.lit(0).alias("__s")).distinct().unionByName(right.select(key, t, F.col(t).alias("__r"), F.lit(1).alias("__s")))
    found = running(both, key, t, [t, "__s"], to, "min", F.col("__r"), back=True, width=width).where("__s = 0").select(key, t, to)
    return left.join(found, [key, t], "left")


def outside(points: DataFrame, spans: DataFrame, key: str, t: str, start: str, end: str, margin: float, width: float) -> DataFrame:
    """Points that lie in no span widened by margin: an anti-join on key and time bucket."""
    p = points.withColumn("__b", F.floor(F.col(t) / width))
    s = spans.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e")).withColumn("__c", F.explode(F.sequence(F.floor((F.col("__s") - margin) / width), F.floor((F.col("__e") + margin) / width))))
    on = (p[key] == s["__k"]) & (p["__b"] == s["__c"]) & (F.col(t) >= F.col("__s") - margin) & (F.col(t) <= F.col("__e") + margin)
    return p.join(s, on, "left_anti").drop("__b")
