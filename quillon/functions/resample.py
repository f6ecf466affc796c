"""Change of the sampling rate: a windowed-sinc filter in phases, and the whole spectrum at once.

With the rates' ratio up / down in lowest terms, output n lies at the input's place n * down / up, whose fraction is one of up phases. Each phase has its
own taps: a sinc cut off at the lower of both Nyquist rates, under a Blackman window that ends at its ZEROS-th zero, scaled to sum to 1. An
output needs only the inputs under its window, so that any stretch of outputs can be made from a stretch of inputs and equals the
same stretch of the whole."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ZEROS = 32
#: Outputs that are made at once.
CHUNK = 4096


def ratio(own: int, rate: int) -> tuple[int, int]:
    g = math.gcd(own, rate)
    return rate // g, own // g


@functools.lru_cache(maxsize=32)
def taps(up: int, down: int, zeros: int = ZEROS) -> np.ndarray:
    """A row for each phase; column j is for the input j - reach(up, down) + 1 after the place's whole part."""
    cut, half = min(1.0, up / down), reach(up, down, zeros)
    t = np.arange(up)[:, None] / up - np.arange(1 - half, half + 1)[None, :]
    u = np.clip(np.abs(t) * cut / zeros, 0, 1)
    h = np.sinc(cut * t) * (0.42 + 0.5 * np.cos(np.pi * u) + 0.08 * np.cos(2 * np.pi * u)) * (u < 1)
    return h / h.sum(1, keepdims=True)


def reach(up: int, down: int, zeros: int = ZEROS) -> int:
    """Inputs on each side of a place that its output needs."""
    return math.ceil(zeros / min(1.0, up / down))


def length_at(n: int, own: int, rate: int) -> int:
    """How many outputs n inputs give."""
    up, down = ratio(own, rate)
    return -(-n * up // down)


def needed(first: int, n: int, own: int, rate: int) -> tuple[int, int]:
    """The inputs [a, b) that outputs first to first + n - 1 need, before they are cut at the recording's ends."""
    up, down = ratio(own, rate)
    if up == down:
        return first, first + n
    half = reach(up, down)
    return first * down // up - half + 1, (first + n - 1) * down // up + half + 1


def resample(x: np.ndarray, own: int, rate: int, first: int = 0, n: int | None = None, begin: int = 0) -> np.ndarray:
    """Outputs first to first + n - 1 (default: all) of a series of which x holds the inputs from begin on; what it doesn't hold is 0."""
    x = np.asarray(x, np.float64)
    n = length_at(len(x), own, rate) if n is None else n
    up, down = ratio(own, rate)
    if up == down:
        out = np.zeros(n)
        a, b = max(first, begin), min(first + n, begin + len(x))
        if a < b:
            out[a - first : b - first] = x[a - begin : b - begin]
        return out
    if not len(x):
        return np.zeros(n)
    h, half = taps(up, down), reach(up, down)
    out = np.empty(n)
    for a in range(0, n, CHUNK):
        place = np.arange(first + a, first + min(n, a + CHUNK), dtype=np.int64) * down
        at = (place // up - begin)[:, None] + np.arange(1 - half, half + 1)
        inside = (at >= 0) & (at < len(x))
        out[a : a + len(place)] = (np.where(inside, x[np.clip(at, 0, len(x) - 1)], 0.0) * h[place % up]).sum(1)
    return out


def fft_resample(x: np.ndarray, n: int) -> np.ndarray:
    """n samples with the spectrum of x, cut or filled up with zeros; the highest of an even number of frequencies is shared by both signs."""
    x = np.asarray(x, np.float64)
    if not len(x) or not n:
        return np.zeros(n)
    low = min(n, len(x))
    spectrum = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    out[: low // 2 + 1] = spectrum[: low // 2 + 1]
    if low % 2 == 0 and n != len(x):
        out[low // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(out, n) * (n / len(x))


def resampled(x: str | Column, own: int, rate: int, method: str = "sinc") -> Column:
    """The series of a column at another rate, as arrays of doubles; method: sinc or fft. Null stays null; nulls in a series count as 0."""

    @F.arrow_udf("array<double>")
    def of(series: pa.Array) -> pa.Array:
        out = []
        for s in series:
            if not s.is_valid:
                out.append(None)
                continue
            v = np.nan_to_num(np.asarray(s.values.to_numpy(zero_copy_only=False), np.float64))
            out.append(resample(v, own, rate) if method == "sinc" else fft_resample(v, length_at(len(v), own, rate)))
        return pa.array(out, pa.list_(pa.float64()))

    return of(x)
