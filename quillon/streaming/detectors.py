"""The detectors over streams: the batch step functions on keyed state. Rows of a key must come in order within a trigger
interval; they are sorted by tick in each batch, and late rows go behind the watermark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import episodes as E


def stream(df: DataFrame, key: str, order: list[str], step: Callable[[dict, tuple], list[dict]], start: Callable[[], dict], schema: str, columns: list[str]) -> DataFrame:
    """What fold() does, over a stream. The state of a key is its dictionary as JSON, bounded by the step's own windows."""
    key_type = dict(df.dtypes)[key]
    names = [key, *[f.split()[0] for f in schema.split(", ")]]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else start()
        rows, out = pd.concat(list(batches)).sort_values(order, kind="stable"), []
        for r in rows[columns].itertuples(index=False):
            out += [{key: k[0]} | x for x in step(s, r)]
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    return df.groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, {schema}", "state string", "append", GroupStateTimeout.NoTimeout)


def stream_episodes(df: DataFrame, key: str, tick: str, p: str, level: str, c: E.EpisodeParams = E.EpisodeParams()) -> DataFrame:
    return stream(df, key, [tick], lambda s, r: E.episode_step(s, float(r[0]), float(r[1]), c), E.episode_state, E.EPISODE_FIELDS, [p, level])


def stream_app(df: DataFrame, key: str, t: str, detected: str, c: E.AppParams = E.AppParams()) -> DataFrame:
    return stream(df, key, [t], lambda s, r: E.app_step(s, float(r[0]), bool(r[1]), c), dict, "t double, mode string, level int, n int", [t, detected])


def stream_rules(df: DataFrame, key: str, tick: str, level: str, ratio: str, c: E.RuleParams = E.RuleParams()) -> DataFrame:
    return stream(df, key, [tick], lambda s, r: [{"tick": int(r[0])} | E.rule_step(s, float(r[1]), float(r[2]), c)], dict, "tick long, " + E.RULE_FIELDS, [tick, level, ratio])


def stream_windows(df: DataFrame, ts: str, key: str, late: str, size: str, hop: str, value: str) -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are left out."""
    from pyspark.sql import functions as F

    w = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size, hop), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")
