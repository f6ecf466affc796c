"""Folds over a stream's rows in the order of their times, with timeouts that fire without a row and states that go.

Rows wait in a key's list until the watermark has passed their time, as an earlier one may come until then; they are then taken in
order. What a machine does at a time of its own (a quiet spell, the end of a rest) is a timer at that time, which fires as soon as the watermark
has passed it, whether a row comes or not. A key without a row for forget_s ends: its machine says what is still open and its state is removed.
A batch gives the same rows as the stream (run_batch), as both take rows and timeouts in the same order; rows behind the watermark are dropped
by Spark before they get here.

State is one value a key and the rows that wait, in packs, in Spark's state store; a trigger touches the keys with rows or due timers only."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.operators import episodes as E

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _nothing(*_) -> list[dict]:
    return []


def _never(_: dict) -> float | None:
    return None


@dataclass(frozen=True)
class Machine:
    """step(state, t, values) -> rows; deadline(state) -> the time of the next timeout; due(state, t) -> rows of a timeout at t; end(state) -> rows for
    what is open when a key ends. Times are seconds. A timeout comes after the rows of its time, and before later ones."""

    start: Callable[[], dict]
    step: Callable[[dict, float, tuple], list[dict]]
    schema: str
    deadline: Callable[[dict], float | None] = _never
    due: Callable[[dict, float], list[dict]] = _nothing
    end: Callable[[dict], list[dict]] = _nothing
    forget_s: float = math.inf


class Run:
    """A machine at work for one key: the state, the time of the last row."""

    def __init__(self, machine: Machine, state: dict | None = None, last: float | None = None):
        self.machine, self.state, self.last = machine, state, last

    def until(self, t: float, whole: bool) -> list[dict]:
        """Timeouts before t (whole: and at t), the key's end among them."""
        out: list[dict] = []
        while self.state is not None:
            m, at = self.machine, self.next()
            if at is None or at > t or at == t and not whole:
                break
            if at >= self.last + m.forget_s:
                out += m.end(self.state)
                self.state = self.last = None
            else:
                out += m.due(self.state, at)
        return out

    def next(self) -> float | None:
        if self.state is None:
            return None
        times = [x for x in (self.machine.deadline(self.state), self.last + self.machine.forget_s) if x is not None and x < math.inf]
        return min(times, default=None)

    def row(self, t: float, values: tuple) -> list[dict]:
        out = self.until(t, False)
        if self.state is None:
            self.state = self.machine.start()
        self.last = t
        return out + self.machine.step(self.state, t, values)


def run_batch(df: DataFrame, key: str, t: str, columns: list[str], machine: Machine, order: tuple[str, ...] = ()) -> DataFrame:
    """What run_stream() gives for the same rows: t is a timestamp, order tells rows of one time apart. Rows without a key or time are left out."""
    rows = df.where(F.col(key).isNotNull() & F.col(t).isNotNull()).withColumn("__t", F.unix_micros(F.col(t).cast("timestamp")))

    def step(s: dict, r: tuple) -> list[dict]:
        run = s.setdefault("run", Run(machine))
        return run.row(r[0] / 1e6, tuple(r[1:]))

    def end(s: dict) -> list[dict]:
        run = s["run"]
        # a stream that goes on would reach all these times
        return run.until(math.inf, False) + (machine.end(run.state) if run.state is not None else [])

    return E.fold(rows, key, ["__t", *order, *columns], step, dict, machine.schema, ["__t", *columns], end)


class OrderedProcessor(StatefulProcessor):
    """Waiting rows are kept in packs, and the time of the timer with the state: each call of the store takes far longer than a row."""

    def __init__(self, names: list[str], columns: list[str], order: list[str], machine: Machine, key: str, out: list[str]):
        self.us = names.index("__us")
        self.order, self.columns = [names.index(c) for c in order], [names.index(c) for c in columns]
        self.machine, self.row = machine, Row(key, *out)
        self.names = out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "data binary")
        self.waiting = handle.getListState("waiting", "data binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # rows of one time by their order, then their values, as in the batch
        new = [(r[self.us], tuple(r[i] for i in self.order), tuple(r[i] for i in self.columns)) for r in rows]
        self.waiting.appendList(_packs(new))
        run, timer = self._load()
        first = min(r[0] for r in new)
        self._keep(run, timer, first, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        every = [r for (data,) in self.waiting.get() for r in pickle.loads(data)]
        ready = sorted((r for r in every if r[0] <= now), key=lambda r: (r[0], *((x is not None, x) for x in (*r[1], *r[2]))))
        later = [r for r in every if r[0] > now]
        (run, _), out = self._load(), []
        for us, _, values in ready:
            out += run.row(us / 1e6, values)
        out += run.until(now / 1e6, True)
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(_packs(later))
        self._keep(run, None, min((r[0] for r in later), default=None), timerValues)
        return iter([self.row(key[0], *(x.get(n) for n in self.names)) for x in out])

    def close(self) -> None:
        pass

    def _load(self) -> tuple[Run, int | None]:
        data = self.value.get()
        if data is None:
            return Run(self.machine), None
        state, last, timer = pickle.loads(bytes(data[0]))
        return Run(self.machine, state, last), timer

    def _keep(self, run: Run, timer: int | None, first: int | None, timerValues) -> None:
        """Keep the state, and one timer a key, at the next time at which there is something to do."""
        times = ([] if first is None else [first]) + ([] if run.next() is None else [run.next() * 1e6])
        old = timer
        if times:
            at = max(math.ceil(min(times) / 1000), timerValues.getCurrentWatermarkInMs() + 1)
            if timer is None or at < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
                timer = at
        if run.state is None and timer is None:
            self.value.clear()
        elif old is None or timer != old:
            self.value.update((pickle.dumps((run.state, run.last, timer)),))


#: Rows that wait in one value of the store.
PACK = 4096


def _packs(rows: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(rows[i : i + PACK]),) for i in range(0, len(rows), PACK)]


def run_stream(df: DataFrame, key: str, t: str, columns: list[str], machine: Machine, late: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The machine over a stream; t is a timestamp, late how long the watermark waits for earlier rows. Needs the RocksDB state store."""
    spark = df.sparkSession
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = df.where(F.col(key).isNotNull() & F.col(t).isNotNull()).withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late)
    rows = rows.select(key, t, F.unix_micros(t).alias("__us"), *[c for c in dict.fromkeys([*order, *columns]) if c not in (key, t)])
    fields = T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(machine.schema)])
    processor = OrderedProcessor(rows.columns, columns, list(order), machine, key, fields.names[1:])
    return rows.groupBy(key).transformWithState(processor, fields, "Append", "EventTime")


def app(c: E.AppParams = E.AppParams(), forget_s: float = 6 * 3600.0) -> Machine:
    """The application over detections: values are (detected,). A night ends after forget_s without a row, and its budget with it."""
    return Machine(dict, lambda s, t, v: E.app_event(s, t, bool(v[0]), c), E.APP_FIELDS, lambda s: E.app_deadline(s, c), lambda s, t: E.app_due(s, t, c), forget_s=forget_s)


def rules(c: E.RuleParams = E.RuleParams(), floor: E.FloorParams = E.FloorParams(), forget_s: float = math.inf) -> Machine:
    """Events of the rule detector over frames (level, ratio), as they close; the open one closes with its key."""

    def step(s: dict, t: float, v: tuple) -> list[dict]:
        E.rule_step(s, float(v[0]), float(v[1]), c, floor)
        out = [_event(x) for x in s["done"]]
        s["done"] = []
        return out

    return Machine(dict, step, "start_ms double, end_ms double, confidence double", end=lambda s: [_event(x) for x in E.rule_flush(s)], forget_s=forget_s)


def _event(x: tuple[float, float, float]) -> dict:
    return dict(zip(("start_ms", "end_ms", "confidence"), x))


def episodes(c: E.EpisodeParams = E.EpisodeParams(), forget_s: float = math.inf) -> Machine:
    """Episodes over ticks (p, level). An open episode has no end row when its key ends."""
    return Machine(E.episode_state, lambda s, t, v: E.episode_step(s, float(v[0]), float(v[1]), c), E.EPISODE_FIELDS, forget_s=forget_s)
