"""Synthetic nights as samples: a bed of noise, pulses in episodes and distractors outside them, put together by blocks of samples.

A night is never one row: the bed's pieces and the parts of each sound are rows (night, block, place in it, samples, how many they fill by
repeating), and a block is the sum of its rows in a fixed order. All draws are hashes of (seed, night, ...), so that the same seed gives the same samples under any partitioning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.hashing import uniform
from quillon.operators.matching import outside
from quillon.operators.nights import place_episodes
from quillon.operators.ranking import global_rank
from quillon.operators.written import kept


@dataclass(frozen=True)
class NightSpec:
    rate: int = 16_000
    duration_s: float = 3600.0
    snr_db: float = 10.0
    bed_dbfs: float = -40.0
    episodes: tuple[int, int] = (6, 12)
    episode_s: tuple[float, float] = (20.0, 120.0)
    period_s: tuple[float, float] = (2.5, 5.0)
    jitter: tuple[float, float] = (0.9, 1.1)
    distractors: tuple[int, int] = (20, 40)
    distractor_db: tuple[float, float] = (0.0, 20.0)
    gap_s: float = 60.0
    margin_s: float = 2.0
    block: int = 16_000 * 10

    @property
    def samples(self) -> int:
        return int(self.duration_s * self.rate)


def draw(seed: int, what: str, *parts) -> Column:
    return uniform(seed, what, *parts)


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * (high - low)


def whole_between(u: Column, low: int, high: int) -> Column:
    return F.least(F.floor(F.lit(low) + u * (high - low + 1)), F.lit(high)).cast("int")


def episodes_of(nights: DataFrame, key: str, seed: int, spec: NightSpec) -> DataFrame:
    """key, episode, start_s, end_s: of a drawn number of episodes those that fit, one after the other."""
    n = whole_between(draw(seed, "episodes", F.col(key)), *spec.episodes)
    return place_episodes(nights, key, seed, spec.episodes[1], spec.duration_s, spec.gap_s, spec.episode_s).where(F.col("episode") < n)


def pulses_of(episodes: DataFrame, key: str, seed: int, spec: NightSpec) -> DataFrame:
    """key, kind, id, t: sounds of a second within each episode, a drawn period apart that varies by the jitter."""
    at = (F.col(key), F.col("episode"))
    rows = episodes.withColumn("__p", between(draw(seed, "period", *at), *spec.period_s))
    most = int(spec.episode_s[1] / (spec.period_s[0] * spec.jitter[0])) + 1
    step = F.struct(F.col("start_s").alias("t"), F.array(F.col("start_s")).alias("all"))
    every = F.aggregate(F.sequence(F.lit(1), F.lit(most)), step, lambda s, k: F.struct((s["t"] + F.col("__p") * between(draw(seed, "jitter", *at, k), *spec.jitter)).alias("t"), F.concat(s["all"], F.array(s["t"] + F.col("__p") * between(draw(seed, "jitter", *at, k), *spec.jitter))).alias("all")))["all"]
    rows = rows.select(key, "episode", "end_s", F.posexplode(every).alias("k", "t")).where(F.col("t") + 1.0 <= F.col("end_s"))
    return rows.select(key, F.lit("pulse").alias("kind"), F.concat_ws(":", "episode", "k").alias("id"), "t")


def distractors_of(nights: DataFrame, episodes: DataFrame, key: str, seed: int, spec: NightSpec) -> DataFrame:
    """key, kind, id, t: of ten times as many tries as are wanted the first that lie outside all episodes widened by the margin."""
    n = whole_between(draw(seed, "distractors", F.col(key)), *spec.distractors)
    tries = nights.select(key, n.alias("n")).select(key, "n", F.explode(F.sequence(F.lit(1), F.lit(10 * spec.distractors[1]))).alias("k")).where(F.col("k") <= 10 * F.col("n"))
    tries = tries.withColumn("t", draw(seed, "try", F.col(key), F.col("k")) * (spec.duration_s - 1.0))
    free = outside(tries, episodes, key, "t", "start_s", "end_s", spec.margin_s, 60.0)
    place = F.row_number().over(Window.partitionBy(key).orderBy("k"))  # of a night's tries, which the spec bounds
    return free.withColumn("__r", place).where(F.col("__r") <= F.col("n")).select(key, F.lit("distractor").alias("kind"), F.col("k").cast("string").alias("id"), "t")


def numbered(sounds: DataFrame, id: str, x: str) -> tuple[DataFrame, int]:
    """Sounds with a number from 0 in the order of their ids, and how many there are."""
    rows = kept(global_rank(sounds.select(F.col(id).alias("sound"), F.col(x).alias("x")), F.floor(F.col("sound") / 4096), ["sound"], "k").withColumn("k", F.col("k") - 1))
    return rows, rows.count()


def rms(x: str) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))


def _pieces(x: Column, start: Column, block: int, samples: int) -> Column:
    """Samples that begin at a place of the night, cut at the ends of blocks: array of (block, at, x)."""
    end = F.least(start + F.size(x), F.lit(samples))
    ids = F.when(end > start, F.sequence(F.floor(start / block), F.floor((end - 1) / block))).otherwise(F.array().cast("array<bigint>"))

    def piece(b: Column) -> Column:
        first, last = F.greatest(start, b * block), F.least(end, (b + 1) * block)
        return F.struct(b.alias("block"), (first - b * block).cast("int").alias("at"), F.slice(x, (first - start + 1).cast("int"), (last - first).cast("int")).alias("x"))

    return F.transform(ids, piece)


def sounds_of(events: DataFrame, key: str, pulses: DataFrame, distractors: DataFrame, seed: int, spec: NightSpec) -> DataFrame:
    """key, kind, id, block, at, x, n: each event's sound, one of those of its kind, brought to its loudness over the bed."""
    parts = []
    bed = 10 ** (spec.bed_dbfs / 20)
    for kind, table in (("pulse", pulses), ("distractor", distractors)):
        rows, n = numbered(table, "id", "x")
        at = (F.col(key), F.col("kind"), F.col("id"))
        mine = events.where(F.col("kind") == kind).withColumn("k", F.least(F.floor(draw(seed, "sound", *at) * n), F.lit(n - 1)))
        db = F.lit(float(spec.snr_db)) if kind == "pulse" else between(draw(seed, "loudness", *at), *spec.distractor_db)
        heard = mine.join(rows, "k").withColumn("__g", bed * F.pow(F.lit(10.0), db / 20)).withColumn("__r", rms("x"))
        heard = heard.withColumn("x", F.when(F.col("__r") > 0, F.transform("x", lambda v: v * (F.col("__g") / F.col("__r")))).otherwise(F.col("x")))
        start = F.floor(F.col("t") * spec.rate)
        parts.append(heard.select(key, "kind", "id", F.inline(_pieces(F.col("x"), start, spec.block, spec.samples))).withColumn("n", F.size("x")))
    return parts[0].unionByName(parts[1])


def beds_of(nights: DataFrame, key: str, beds: DataFrame, seed: int, spec: NightSpec) -> DataFrame:
    """key, kind, id, block, at, x, n: one of the beds (id, x), from a drawn place on and again from its start, at its loudness. A bed is cut into chunks of a
    block's size, so that a block needs a few chunks and not the bed. One that is shorter than a block is a single row of each block: x repeated to n samples."""
    rows, n = numbered(beds, "id", "x")
    mine = nights.select(key, F.least(F.floor(draw(seed, "bed", F.col(key)) * n), F.lit(n - 1)).alias("k")).join(rows.select("k", F.size("x").alias("size")).where("size > 0"), "k")
    mine = mine.withColumn("from", F.floor(draw(seed, "from", F.col(key)) * F.col("size")))
    id = F.format_string("%015d", F.col("start"))
    power = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)

    long = F.col("size") >= spec.block
    chunks = rows.where(F.size("x") >= spec.block).select("k", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / spec.block).cast("int")), lambda c: F.slice("x", c * spec.block + 1, spec.block))).alias("chunk", "x"))
    # where each pass over the bed begins in the night (the first one before it), and its chunks that lie in the night
    passes = mine.where(long).withColumn("begin", F.explode(F.sequence(-F.col("from"), F.lit(spec.samples - 1).cast("long"), F.col("size").cast("long"))))
    one = passes.join(chunks, "k").withColumn("start", F.col("begin") + F.col("chunk") * spec.block)
    skip = F.greatest(F.lit(0), -F.col("start"))
    one = one.where((F.col("start") < spec.samples) & (F.col("start") + F.size("x") > 0)).withColumn("x", F.slice("x", (skip + 1).cast("int"), F.size("x"))).withColumn("start", F.greatest("start", F.lit(0)))
    pieces = one.select(key, F.lit("bed").alias("kind"), id.alias("id"), F.inline(_pieces(F.col("x"), F.col("start"), spec.block, spec.samples))).select("*", F.size("x").alias("n"), power("x").alias("p"))

    last = (spec.samples - 1) // spec.block
    short = mine.where(~long).join(rows.select("k", "x"), "k").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).withColumn("start", F.col("block") * spec.block)
    short = short.withColumn("n", F.least(F.lit(spec.block), F.lit(spec.samples) - F.col("start")).cast("int"))
    off = F.pmod(F.col("from") + F.col("start"), F.col("size")).cast("int")
    short = short.withColumn("x", F.concat(F.slice("x", off + 1, F.col("size") - off), F.slice("x", F.lit(1), off)))
    whole = F.floor(F.col("n") / F.col("size")) * power("x") + power(F.slice("x", F.lit(1), F.col("n") % F.col("size")))
    pieces = kept(pieces.unionByName(short.select(key, F.lit("bed").alias("kind"), id.alias("id"), "block", F.lit(0).alias("at"), "x", "n", whole.alias("p"))))
    loud = pieces.groupBy(key).agg(F.sqrt(F.sum(F.col("p").cast("decimal(38,18)")).cast("double") / spec.samples).alias("__r"))
    gain = 10 ** (spec.bed_dbfs / 20) / F.col("__r")
    return pieces.drop("p").join(loud, key).withColumn("x", F.when(F.col("__r") > 0, F.transform("x", lambda v: v * gain)).otherwise(F.col("x"))).drop("__r")


def night_blocks(nights: DataFrame, key: str, beds: DataFrame, pulses: DataFrame, distractors: DataFrame, seed: int, spec: NightSpec = NightSpec()) -> tuple[DataFrame, DataFrame]:
    """(key, block, x) of every block of every night, within -1 and 1, and its episodes (key, episode, start_s, end_s). beds, pulses and distractors: id, x."""
    nights = kept(nights.select(key).distinct())
    episodes = kept(episodes_of(nights, key, seed, spec))
    events = pulses_of(episodes, key, seed, spec).unionByName(distractors_of(nights, episodes, key, seed, spec))
    rows = beds_of(nights, key, beds, seed, spec).unionByName(sounds_of(kept(events), key, pulses, distractors, seed, spec))
    # a block that nothing falls in, of a night without a bed
    last = (spec.samples - 1) // spec.block
    empty = nights.select(key, F.lit("").alias("kind"), F.lit("").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("block"), F.lit(0).alias("at"), F.array().cast("array<double>").alias("x"), F.lit(0).alias("n"))
    schema = T.StructType([nights.schema[key], T.StructField("block", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def add(group: pa.Table) -> pa.Table:
        b = group.column("block")[0].as_py()
        out = np.zeros(min(spec.block, spec.samples - b * spec.block))
        at, n, x = (group.column(c).to_pylist() if c != "x" else group.column(c).combine_chunks() for c in ("at", "n", "x"))
        ends, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
        order = sorted(range(len(at)), key=list(zip(group.column("kind").to_pylist(), group.column("id").to_pylist(), at)).__getitem__)
        for i in order:
            v = flat[ends[i] : ends[i + 1]]
            if n[i]:
                out[at[i] : at[i] + n[i]] += v if len(v) == n[i] else np.resize(v, n[i])
        return pa.table([group.column(key).slice(0, 1), pa.array([b], pa.int64()), pa.array([np.clip(out, -1, 1)], pa.list_(pa.float64()))], names=[key, "block", "x"])

    return rows.unionByName(empty).groupBy(key, "block").applyInArrow(add, schema), episodes
