"""Direction of a source from the lags of two channels: the frames of an episode that are loud and coherent vote."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from quillon.functions import dsp


@dataclass(frozen=True)
class DirectionParams:
    max_lag: int = 4
    min_ratio: float = 1.5
    floor_margin: float = 6.0
    deadzone: float = 0.2
    lag_bin: float = 0.01
    floor_start: float = -60.0
    fall: float = 0.02
    rise: float = 0.002
    rate: float = 16000.0
    size: int = 512
    band: tuple[float, float] = (60.0, 3000.0)


def side(lag: float, c: DirectionParams) -> str:
    border = c.deadzone * c.max_lag
    return "left" if lag > border else "right" if lag < -border else "unknown"


def direction_step(s: dict, level: float, lag: float, ratio: float, c: DirectionParams = DirectionParams()) -> bool:
    """One frame; true if it counts: loud against the floor before it, and coherent. Loud coherent frames leave the floor as it is."""
    if not s:
        s.update(floor=c.floor_start, lags={}, sides={}, n=0)
    coherent = ratio >= c.min_ratio
    counts = level >= s["floor"] + c.floor_margin and coherent
    if level < s["floor"] + 5.0:
        s["floor"] += c.fall * (level - s["floor"])
    elif not coherent:
        s["floor"] += c.rise * (level - s["floor"])
    if counts:
        top = int(round(2 * c.max_lag / c.lag_bin))
        at = min(max(math.floor((lag + c.max_lag) / c.lag_bin + 0.5), 0), top)
        s["lags"][at] = s["lags"].get(at, 0) + 1
        s["sides"][side(lag, c)] = s["sides"].get(side(lag, c), 0) + 1
        s["n"] += 1
    return counts


def direction(s: dict, c: DirectionParams = DirectionParams()) -> dict:
    """The side of the lower median lag of the frames that counted, and the share of them on that side."""
    n = s.get("n", 0)
    if not n:
        return {"side": "unknown", "lag": 0.0, "lag_ms": 0.0, "confidence": 0.0, "frames": 0}
    seen = 0
    for at in sorted(s["lags"]):
        seen += s["lags"][at]
        if seen >= (n - 1) // 2 + 1:
            break
    lag = at * c.lag_bin - c.max_lag
    return {"side": side(lag, c), "lag": lag, "lag_ms": lag / c.rate * 1000, "confidence": s["sides"].get(side(lag, c), 0) / n, "frames": n}


def new_episode(s: dict) -> None:
    """Forget the votes; the floor stays."""
    if s:
        s.update(lags={}, sides={}, n=0)


def classify(left: np.ndarray, right: np.ndarray, c: DirectionParams = DirectionParams()) -> dict:
    """Half-overlapping frames of two channels, folded."""
    s: dict = {}
    for k in range(0, len(left) - c.size + 1, c.size // 2):
        x, y = np.asarray(left[k : k + c.size], float), right[k : k + c.size]
        level = 20 * math.log10(math.sqrt((x * x).mean()) + 1e-9)
        direction_step(s, level, *dsp.gcc_phat(x, y, c.max_lag, c.rate, c.band, c.size), c)
    return direction(s, c)
