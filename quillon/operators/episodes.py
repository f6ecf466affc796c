"""Stateful detectors as step functions: the same function runs over sorted groups in batch and over keyed state in a stream.

A step takes (state, row) and returns the rows it emits; states are plain dictionaries, so they can be kept as JSON."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class EpisodeParams:
    tau: float = 0.65
    tick_ms: int = 500
    hold: int = 12
    confirm: int = 20
    verify: int = 30
    min_bursts: int = 3
    period_min: int = 3
    period_max: int = 14


def episode_state() -> dict:
    return {"mode": "IDLE", "tick": 0, "p": [], "bursts": [], "hits": [], "in_burst": False, "streak": 0, "below": 0, "episode": 0, "start": 0, "n": 0, "sum": 0.0, "last": 0, "levels": 0.0, "n_bursts": 0}


def periodic(bursts: list[int], c: EpisodeParams) -> bool:
    if len(bursts) < max(2, c.min_bursts):
        return False
    gaps = sorted(b - a for a, b in zip(bursts, bursts[1:]))
    return c.period_min <= gaps[(len(gaps) - 1) // 2] <= c.period_max


def episode_step(s: dict, p: float, level: float, c: EpisodeParams) -> list[dict]:
    """One tick: idle, active while something is heard, confirmed when it has been periodic for long enough."""
    i, out = s["tick"], []
    s["tick"] += 1
    s["p"] = (s["p"] + [p])[-(c.hold + 1) :]
    hit, active = p >= c.tau, max(s["p"]) >= c.tau
    new_burst = hit and not s["in_burst"]
    if new_burst:
        s["bursts"].append(i)
    if hit:
        s["hits"].append((i, p, level))
    s["in_burst"] = hit
    oldest = i - c.confirm - c.hold
    s["bursts"] = [t for t in s["bursts"] if t >= oldest]
    s["hits"] = [h for h in s["hits"] if h[0] >= oldest]
    s["streak"] = min(s["streak"] + 2, 4 * c.confirm) if active else max(0, s["streak"] - 1)
    if s["mode"] == "IDLE" and active:
        s["mode"] = "ACTIVE"
    if s["mode"] == "ACTIVE":
        if s["streak"] == 0:
            s["mode"] = "IDLE"
        elif s["streak"] >= 2 * c.confirm and periodic(s["bursts"], c):
            start = s["bursts"][0]
            own = [h for h in s["hits"] if h[0] >= start]
            s.update(mode="CONFIRMED", episode=s["episode"] + 1, start=start, n=len(own), sum=sum(h[1] for h in own), levels=sum(h[2] for h in own), last=own[-1][0], below=0, n_bursts=len(s["bursts"]))
            out.append({"type": "episode_start", "episode_id": s["episode"], "tick": i, "t": start * c.tick_ms / 1000, "n_bursts": s["n_bursts"]})
    elif s["mode"] == "CONFIRMED":
        if new_burst:
            s["n_bursts"] += 1
        if hit:
            s.update(n=s["n"] + 1, sum=s["sum"] + p, levels=s["levels"] + level, last=i)
        s["below"] = 0 if active else s["below"] + 1
        if s["below"] >= c.verify:
            tick = c.tick_ms / 1000
            out.append({"type": "episode_end", "episode_id": s["episode"], "tick": i, "t": i * tick, "n_bursts": s["n_bursts"], "start_t": s["start"] * tick, "duration_s": (s["last"] - s["start"] + 2) * tick, "mean_p": s["sum"] / max(s["n"], 1), "n_hits": s["n"], "level_dbfs": s["levels"] / max(s["n"], 1)})
            s.update(mode="IDLE", streak=0, bursts=[], hits=[], in_burst=False, below=0)
    return out


def tick_end(tick, tick_s: float = 0.5):
    """When the window of a tick (number or column) has ended: it begins at the tick and takes two."""
    return (tick + 2) * tick_s


EPISODE_FIELDS = "type string, episode_id int, tick long, t double, n_bursts int, start_t double, duration_s double, mean_p double, n_hits int, level_dbfs double"


@dataclass(frozen=True)
class FloorParams:
    start: float = -60.0
    alpha: float = 0.02
    margin: float = 5.0


def floor_step(s: dict, e: float, c: FloorParams) -> float:
    """Moving average that only follows levels below the floor plus a margin."""
    f = s.setdefault("floor", c.start)
    if e < f + c.margin:
        s["floor"] = f = (1 - c.alpha) * f + c.alpha * e
    return f


def coherent_floor_step(s: dict, e: float, coherent: bool, down: float = 0.2, up: float = 0.005) -> float:
    """Falls fast, rises slowly while the signal is incoherent, and stands still while it is coherent."""
    f = s.setdefault("floor", e)
    if e < f:
        f += down * (e - f)
    elif not coherent:
        f += up * (e - f)
    s["floor"] = f
    return f


def streak_step(s: dict, active: bool, most: int) -> int:
    s["streak"] = min(s.get("streak", 0) + 2, most) if active else max(0, s.get("streak", 0) - 1)
    return s["streak"]


@dataclass(frozen=True)
class RuleParams:
    """Energy gate over the floor, band ratio gate, then a ring of levels that must hold periodic peaks."""

    frame_ms: float = 32.0
    energy_gate: float = 3.0
    ratio_gate: float = 0.55
    history: int = 64
    unheard: float = -80.0
    duration_min_ms: float = 300.0
    duration_max_ms: float = 5000.0
    period_min_ms: float = 1500.0
    period_max_ms: float = 7000.0
    confirm: int = 2
    peak_factor: float = 1.2


RULE_FIELDS = "mode int, hit boolean, confidence double, clock_ms double, noise_floor double"


def ring_is_periodic(h: list[float], c: RuleParams) -> bool:
    """Whether enough neighbouring peaks of the ring, read in the order of its slots, are a period apart."""
    above = sum(h) / len(h) * c.peak_factor
    peaks = [i for i in range(2, len(h) - 2) if h[i] > above and h[i] > max(h[i - 2], h[i - 1], h[i + 1], h[i + 2])]
    low, high = max(1, int(c.period_min_ms / c.frame_ms)), min(int(c.period_max_ms / c.frame_ms), len(h) - 1)
    return sum(low <= b - a <= high for a, b in zip(peaks, peaks[1:])) >= c.confirm


def rule_step(s: dict, level: float, ratio: float, c: RuleParams, floor: FloorParams = FloorParams()) -> dict:
    """One frame: mode 0 quiet, 1 candidate, 2 confirmed. The clock runs only on frames that pass both gates, and
    with the default history two whole periods hardly fit, so little is confirmed (see the README)."""
    f = floor_step(s, level, floor)
    if "ring" not in s:
        s.update(mode=0, clock=0.0, ring=[c.unheard] * c.history, at=0, start=0.0, done=[])
    hit, sure = False, 0.0
    if level - f < c.energy_gate or ratio < c.ratio_gate:
        if s["mode"] == 2:
            s["done"].append((s["start"], s["clock"], 0.8))
        s["mode"] = 0
        return {"mode": 0, "hit": False, "confidence": 0.0, "clock_ms": s["clock"], "noise_floor": f}
    s["ring"][s["at"]] = level
    s["at"] = (s["at"] + 1) % c.history
    s["clock"] += c.frame_ms
    length = s["clock"] - s["start"]
    if s["mode"] == 0:
        s.update(mode=1, start=s["clock"])
    elif s["mode"] == 1:
        if c.duration_min_ms < length < c.duration_max_ms and ring_is_periodic(s["ring"], c):
            s["mode"], hit, sure = 2, True, 0.7 + (ratio - 0.55) * 0.5
        elif length > c.duration_max_ms:
            s["mode"] = 0
    else:
        hit, sure = True, 0.85
        if length > c.duration_max_ms:
            s["done"].append((s["start"], s["clock"], 0.85))
            s["mode"] = 0
    return {"mode": s["mode"], "hit": hit, "confidence": sure, "clock_ms": s["clock"], "noise_floor": f}


def rule_flush(s: dict) -> list[tuple[float, float, float]]:
    """Events (start, end, confidence) at the end of a stream, an open one included."""
    return [*s.get("done", []), *([(s["start"], s["clock"], 0.8)] if s.get("mode") == 2 else [])]


def new_night(s: dict) -> None:
    """Forget the running event and the events so far; the floor and the ring stay."""
    s.update(mode=0, start=s.get("clock", 0.0), done=[])


def fold(df: DataFrame, key: str, order: list[str], step: Callable[[dict, list], list[dict]], start: Callable[[], dict], schema: str, columns: list[str], end: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """Run a step over each key's rows in order, and end(state) after its last one.

    Rows are dealt by key, sorted (Spark spills) and read in batches; a task holds a batch and one key's state, so a key may have any number of rows."""
    fields = T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(schema)])
    rows = df.select(key, *dict.fromkeys([*order, *columns])).repartition(key).sortWithinPartitions(key, *order)
    kinds, at = to_arrow_schema(fields), [rows.columns.index(c) for c in columns]

    def run(batches):
        now, s, begun = None, start(), False
        for batch in batches:
            keys, values, out = batch.column(0).to_pylist(), [batch.column(i).to_pylist() for i in at], []
            for k, row in zip(keys, zip(*values)):
                if begun and k != now:
                    out += [{key: now} | x for x in end(s)] if end else []
                    s = start()
                now, begun = k, True
                out += [{key: k} | x for x in step(s, row)]
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if begun and end:
            yield pa.RecordBatch.from_pylist([{key: now} | x for x in end(s)], schema=kinds)

    return rows.mapInArrow(run, fields)


def episodes(df: DataFrame, key: str, tick: str, p: str, level: str, c: EpisodeParams = EpisodeParams()) -> DataFrame:
    return fold(df, key, [tick], lambda s, r: episode_step(s, float(r[0]), float(r[1]), c), episode_state, EPISODE_FIELDS, [p, level])


def run_ticks(p: list[float], level: list[float] | None = None, c: EpisodeParams = EpisodeParams()) -> tuple[list[dict], dict]:
    s, out = episode_state(), []
    for i, x in enumerate(p):
        out += episode_step(s, x, level[i] if level else 0.0, c)
    return out, s


@dataclass(frozen=True)
class AppParams:
    calibrate_s: float = 10.0
    escalate_s: float = 10.0
    timeout_s: float = 120.0
    quiet_s: float = 5.0
    budget: int = 15
    rest_s: float = 3600.0
    cooldown_s: float = 60.0
    top_level: int = 3


APP_FIELDS = "t double, mode string, level int, n int, success boolean"


def _app_go(s: dict, out: list[dict], t: float, mode: str, success: bool | None = None, **more) -> None:
    s.update(mode=mode, since=t, **more)
    out.append({"t": t, "mode": mode, "level": s["level"], "n": s["n"], "success": success})


def _app_start(s: dict, t: float) -> None:
    if not s:
        s.update(mode="CALIBRATE", since=t, level=1, n=0, heard=t, until=t)


def _app_detected(s: dict, out: list[dict], t: float, c: AppParams) -> None:
    """The level rises at each detection more than escalate_s after the intervention's start, before the timeout is looked at, so that the rest after
    it is that of the raised level."""
    if s["mode"] == "MONITOR" and s["n"] >= c.budget:
        _app_go(s, out, t, "COOLDOWN", until=t + c.rest_s)  # the night's budget stays spent
    elif s["mode"] == "MONITOR":
        _app_go(s, out, t, "INTERVENE", level=1, n=s["n"] + 1)
    elif s["mode"] == "INTERVENE":
        if t - s["since"] > c.escalate_s and s["level"] < c.top_level:
            s["level"] += 1
            out.append({"t": t, "mode": "INTERVENE", "level": s["level"], "n": s["n"], "success": None})
        if t - s["since"] > c.timeout_s:
            _app_go(s, out, t, "COOLDOWN", False, until=t + c.cooldown_s * s["level"])
    s["heard"] = t


def app_step(s: dict, t: float, detected: bool, c: AppParams = AppParams()) -> list[dict]:
    """Calibrate, monitor, intervene at rising levels, cool down; success tells how an intervention ended. For rows that come all the time,
    with or without a detection: in this order a tick ends calibration, takes a detection, ends a rest and finds a quiet spell longer than quiet_s."""
    out: list[dict] = []
    _app_start(s, t)
    if s["mode"] == "CALIBRATE" and t - s["since"] >= c.calibrate_s:
        _app_go(s, out, t, "MONITOR")
    if detected:
        _app_detected(s, out, t, c)
    if s["mode"] == "COOLDOWN" and t >= s["until"]:
        _app_go(s, out, t, "MONITOR")
    if s["mode"] == "INTERVENE" and t - s["heard"] > c.quiet_s:
        _app_go(s, out, t, "COOLDOWN", True, until=t + c.cooldown_s * s["level"])
    return out


def app_event(s: dict, t: float, detected: bool, c: AppParams = AppParams()) -> list[dict]:
    """app_step() for rows that come now and then: what time alone brings is done by app_due(), at its own time."""
    out: list[dict] = []
    _app_start(s, t)
    if detected:
        _app_detected(s, out, t, c)
    return out


def app_deadline(s: dict, c: AppParams = AppParams()) -> float | None:
    """When time alone brings the next change of mode."""
    if not s:
        return None
    return {"CALIBRATE": s["since"] + c.calibrate_s, "COOLDOWN": s["until"], "INTERVENE": s["heard"] + c.quiet_s}.get(s["mode"])


def app_due(s: dict, t: float, c: AppParams = AppParams()) -> list[dict]:
    out: list[dict] = []
    if s["mode"] == "INTERVENE":
        _app_go(s, out, t, "COOLDOWN", True, until=t + c.cooldown_s * s["level"])
    else:
        _app_go(s, out, t, "MONITOR")
    return out
