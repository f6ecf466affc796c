"""Queries on spectra, recordings' features and detectors over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions import dsp
from quillon.operators import episodes as E
from quillon.operators import features, night_audio
from quillon.operators.written import shared_folder
from quillon.plans.q_arrays import X, frames
from quillon.plans.q_metrics import r6
from quillon.plans.q_series import APP, EPISODE_FSM, EPISODES, RULE_FLOOR, RULES
from quillon.plans.registry import query, table
from quillon.streaming import detectors, ordered

#: The discrete Fourier transform of 64 samples under a symmetric Hann window, term by term.
TERM = "list_sum(list_transform(range(64), lambda n: x[n + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 63)) * {}(2 * pi() * bin * n / 64)))"


@query("frame_spectrum", f"WITH {X}, k AS (SELECT vec_id, x, unnest(range(32)) AS bin FROM x) SELECT vec_id, bin::INT AS bin, round(sqrt(pow({TERM.format('cos')}, 2) + pow({TERM.format('sin')}, 2)) / 32, 6) AS magnitude FROM k")
def frame_spectrum(spark, d):
    return r6(frames(spark, d).select("vec_id", F.posexplode(dsp.magnitude_column(F.col("x"))).alias("bin", "magnitude")))


#: Features of frames of 64 samples: windows of 32, every 16, in 4 bands.
SMALL = dsp.FeatureSpec("small", size=32, hop=16, mels=4)
BANK = ", ".join(f"({m}, {k}, {w!r}::DOUBLE)" for m, row in enumerate(dsp.filterbank(SMALL).tolist()) for k, w in enumerate(row) if w)
PART = "list_sum(list_transform(range(32), lambda n: x[frame * 16 + n + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 32)) * {}(2 * pi() * bin * n / 32)))"


@query("log_mel_features", f"""WITH {X}, bank(mel, bin, w) AS (VALUES {BANK}), k AS (SELECT vec_id, x, frame, bin FROM x, (SELECT unnest(range(3)) AS frame), (SELECT unnest(range(17)) AS bin)),
s AS (SELECT vec_id, frame, bin, pow({PART.format('cos')}, 2) + pow({PART.format('sin')}, 2) AS power FROM k),
m AS (SELECT vec_id, frame, mel, 10 * log10(sum(power * w) + 1e-10) AS db FROM s JOIN bank USING (bin) GROUP BY ALL)
SELECT vec_id, frame::INT AS frame, mel::INT AS mel, round(greatest(-1, least(1, (db - avg(db) OVER (PARTITION BY vec_id)) / 40)), 6) AS value FROM m""")
def log_mel_features(spark, d):
    """Scaled mel bands of every frame."""
    f = frames(spark, d).select("vec_id", F.posexplode(dsp.log_mel_column(F.col("x"), SMALL)).alias("frame", "bands"))
    return r6(f.select("vec_id", "frame", F.posexplode("bands").alias("mel", "value")))


SPECTRUM = "sum({} * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 64)) * {}(2 * pi() * bin * n / 64))"


@query("phat_lag", f"""WITH {X}, s AS (SELECT vec_id, n, x[n + 1] AS l, CASE WHEN n < 3 THEN 0.0::DOUBLE ELSE x[n - 2] END AS r FROM (SELECT vec_id, x, unnest(range(64)) AS n FROM x)),
f AS (SELECT vec_id, bin, {SPECTRUM.format('l', 'cos')} AS lc, -{SPECTRUM.format('l', 'sin')} AS ls, {SPECTRUM.format('r', 'cos')} AS rc, -{SPECTRUM.format('r', 'sin')} AS rs FROM s, (SELECT unnest(range(1, 13)) AS bin) GROUP BY ALL),
g AS (SELECT vec_id, bin, rc * lc + rs * ls AS re, rs * lc - rc * ls AS im FROM f), h AS (SELECT vec_id, bin, re / (sqrt(re * re + im * im) + 1e-12) AS re, im / (sqrt(re * re + im * im) + 1e-12) AS im FROM g),
c AS (SELECT vec_id, lag, sum(2 * (re * cos(2 * pi() * bin * lag / 64) - im * sin(2 * pi() * bin * lag / 64))) / 64 AS c FROM h, (SELECT unnest(range(-8, 9)) AS lag) GROUP BY ALL),
k AS (SELECT vec_id, arg_max(lag, c) AS k, max(c) AS y FROM c GROUP BY 1),
n AS (SELECT k.vec_id, k, y, max(CASE WHEN lag = k - 1 THEN c END) AS y0, max(CASE WHEN lag = k + 1 THEN c END) AS y2, max(CASE WHEN abs(lag - k) > 1 THEN c END) AS second FROM k JOIN c USING (vec_id) GROUP BY ALL)
SELECT vec_id, round(k + CASE WHEN abs(k) < 8 AND y0 - 2 * y + y2 < 0 THEN 0.5::DOUBLE * (y0 - y2) / (y0 - 2 * y + y2) ELSE 0 END, 6) AS lag, round(CASE WHEN second > 1e-9 THEN y / second ELSE 'inf'::DOUBLE END, 4) AS confidence FROM n""")
def phat_lag(spark, d):
    """Each frame against itself three samples later."""
    x = frames(spark, d).select("vec_id", "x", A.shift(F.col("x"), 3).alias("y"))
    lag = x.select("vec_id", dsp.lag_column(F.col("x"), F.col("y"), 8, size=64).alias("l"))
    return lag.select("vec_id", F.round("l.lag", 6).alias("lag"), F.round("l.confidence", 4).alias("confidence"))


@query("stream_episode_fsm", EPISODE_FSM)
def stream_episode_fsm(spark, d):
    """episode_fsm over a stream of the event files, until all that is there has been read."""
    rows = event_stream(spark, d).withColumn("p", F.least(F.col("value") / 100, F.lit(1.0)))
    step = lambda s, r: E.episode_step(s, float(r[0]), float(r[1]), EPISODES)
    out = detectors.stream(rows, "user_id", ["ts", "event_id"], step, E.episode_state, E.EPISODE_FIELDS, ["p", "value"])
    return written_stream(out).withColumn("t_end", E.tick_end(F.col("tick"))).withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("mean_p", "level_dbfs")})


#: The application's times, stretched to events that come hours apart; a week without one ends what a user began.
FORGET_S = 7 * 86_400.0


def detections(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.where("value >= 80").withColumn("detected", F.lit(True))


@query("app_timers")
def app_timers(spark, d):
    """The application over detections alone: what time brings comes at its own time."""
    return ordered.run_batch(detections(spark, d), "user_id", "ts", ["detected"], ordered.app(APP, FORGET_S), ("event_id",))


def written_stream(out):
    """What a stream gives until all that is there has been read."""
    at = shared_folder(out.sparkSession)
    q = out.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{at}/rows")


def event_stream(spark, d):
    # as a pattern: a stream takes a plain path for a folder, and the table may be one file
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


@query("stream_app_timers")
def stream_app_timers(spark, d):
    """app_timers over a stream of the event files, up to the last event."""
    rows = event_stream(spark, d).where("value >= 80").withColumn("detected", F.lit(True))
    return written_stream(ordered.run_stream(rows, "user_id", "ts", ["detected"], ordered.app(APP, FORGET_S), "1 second", ("event_id",)))


@query("stream_rule_events")
def stream_rule_events(spark, d):
    """The rule detector's events over a stream of the event files, as they close."""
    rows = event_stream(spark, d).withColumn("ratio", F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(100)) / 100)
    return written_stream(ordered.run_stream(rows, "user_id", "ts", ["value", "ratio"], ordered.rules(RULES, RULE_FLOOR), "1 second", ("event_id",)))


@query("night_blocks")
def night_blocks(spark, d):
    """A night for each user: vectors as sounds of a second at 64 samples a second, of label 0 as beds, of odd ids as pulses, the others as distractors; a digest of each block."""
    spec = night_audio.NightSpec(rate=64, duration_s=300.0, episodes=(2, 4), episode_s=(20.0, 40.0), distractors=(4, 8), gap_s=20.0, block=64 * 50)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    nights = table(spark, d, "events").select("user_id").where("user_id IS NOT NULL")
    blocks, _ = night_audio.night_blocks(nights, "user_id", v.where("label = 0").drop("label"), v.where("id % 2 = 1").drop("label"), v.where("id % 2 = 0 AND label <> 0").drop("label"), 7, spec)
    power = F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)
    return blocks.select("user_id", "block", F.size("x").alias("n"), F.round(power, 6).alias("power"), F.round(F.array_max("x"), 6).alias("peak"))


@query("feature_skips", f"SELECT label, count(*) AS rows, count(*) FILTER (WHERE n >= 64) AS kept, count(*) FILTER (WHERE n < 64 OR n IS NULL) AS skipped FROM (SELECT label, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE least(64, 40 + vec_id % 40) END AS n FROM embeddings) GROUP BY label")
def feature_skips(spark, d):
    """Vectors cut to lengths by their ids, or to nothing: those that don't fill three frames are skipped and counted."""
    x = F.when(F.col("vec_id") % 11 != 0, F.slice("x", 1, F.least(F.lit(64), 40 + F.col("vec_id") % 40).cast("int")))
    return features.skip_counts(features.feature_rows(frames(spark, d).withColumn("x", x), "x", 3, SMALL), "label")
