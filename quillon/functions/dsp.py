"""Spectra and features of frames: numpy in Arrow batches, as Spark has no FFT. Each function is a column in, a column out."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureSpec:
    """What a feature matrix was made with; features of different specs must not be mixed."""

    version: str = "spec-1"
    rate: int = 16000
    size: int = 512
    hop: int = 256
    mels: int = 30
    low_hz: float = 40.0
    high_hz: float = 6000.0
    magnitude: bool = False
    eps: float = 1e-10
    scale: str = "centred"  # centred: (dB - mean) / 40 within -1..1; minmax: 0..1
    periodic: bool = True
    bank: str = "continuous"  # or whole bins: "size" or "bins", see filterbank()
    frames: int | None = None  # frames to pad with zeros or to cut to, before scaling
    flat: float = 0.0  # minmax: a range below this gives zeros
    over: float = 0.0  # minmax: added to the range
    centred: bool = False  # frames around multiples of the hop, with zeros beyond the ends
    whole: bool = False  # zeros at the end, up to a whole number of hops
    by_window: bool = False  # spectra over the sum of the window
    mel: str = "log10"  # or "linear_log": linear up to 1,000 Hz
    equal_area: bool = False  # triangles over half their width in Hz
    top_db: float | None = None  # decibels under the loudest band, none lower than this


SPEC_1 = FeatureSpec()
MAGNITUDE = FeatureSpec("magnitude-minmax", magnitude=True, eps=1e-6, scale="minmax", periodic=False, frames=61, flat=1e-9)
#: Decibels under the loudest band, on a scale that is linear up to 1,000 Hz, with triangles of equal area.
TOP_DB = FeatureSpec("top-db-minmax", scale="minmax", over=1e-8, centred=True, mel="linear_log", equal_area=True, top_db=80.0)
#: Natural logarithms of spectra over the window's sum, with triangles between whole bins.
WHOLE_BINS = FeatureSpec("whole-bins-minmax", eps=1e-6, scale="minmax", over=1e-8, centred=True, whole=True, by_window=True, bank="bins")
POWER = FeatureSpec("power-minmax", low_hz=0.0, high_hz=8000.0, eps=1e-9, scale="minmax", periodic=False, bank="size", over=1e-9)


def spec_dict(spec: FeatureSpec) -> dict:
    return asdict(spec)


def window(n: int, periodic: bool) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))


def mel_edges(spec: FeatureSpec) -> np.ndarray:
    """The Hz of the bands' edges, equally far from each other on the scale."""
    if spec.mel == "linear_log":  # 15 steps up to 1,000 Hz, then 27 for each factor of 6.4
        to = lambda f: 3 * f / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)
        m = np.linspace(to(spec.low_hz), to(spec.high_hz), spec.mels + 2)
        return np.where(m < 15, 200 * m / 3, 1000 * np.exp(math.log(6.4) * (np.maximum(m, 15) - 15) / 27))
    to = lambda f: 2595 * math.log10(1 + f / 700)
    return 700 * (10 ** (np.linspace(to(spec.low_hz), to(spec.high_hz), spec.mels + 2) / 2595) - 1)


def filterbank(spec: FeatureSpec, kind: str | None = None) -> np.ndarray:
    """Triangles on the mel scale, (mels, size / 2 + 1). kind: continuous centres, or whole bins by bins or by size."""
    edges = mel_edges(spec)
    n, kind = spec.size // 2 + 1, kind or spec.bank
    if kind == "continuous":
        at, place = np.arange(n) * spec.rate / spec.size, edges
    else:
        at = np.arange(n, dtype=float)
        place = np.floor((n - 1) * edges / (spec.rate / 2) if kind == "bins" else (spec.size + 1) * edges / spec.rate)
    out = np.zeros((spec.mels, n))
    for m in range(spec.mels):
        a, b, c = place[m : m + 3]
        if kind != "continuous":  # a bin on two edges belongs to the falling side
            rise, fall = (at >= a) & (at < b), (at >= b) & (at < c)
            out[m, rise], out[m, fall] = (at[rise] - a) / max(b - a, 1), (c - at[fall]) / max(c - b, 1)
            continue
        up, down = (at - a) / max(b - a, 1e-12), (c - at) / max(c - b, 1e-12)
        out[m] = np.maximum(0, np.minimum(up, down))
    return out * (2 / (edges[2:] - edges[:-2]))[:, None] if spec.equal_area else out


def sparse_filterbank(bank: np.ndarray) -> list[tuple[int, list[float]]]:
    """For each row where it begins and its weights up to the last that isn't zero."""
    out = []
    for row in bank:
        at = np.flatnonzero(row)
        out.append((int(at[0]), row[at[0] : at[-1] + 1].tolist()) if len(at) else (0, []))
    return out


def stft(x: np.ndarray, spec: FeatureSpec) -> np.ndarray:
    """Spectra of all full frames."""
    if spec.centred:
        x = np.pad(x, spec.size // 2)
    if spec.whole:
        x = np.pad(x, (0, -(len(x) - spec.size) % spec.hop if len(x) >= spec.size else spec.size - len(x)))
    if len(x) < spec.size:
        return np.zeros((0, spec.size // 2 + 1), complex)
    frames = np.lib.stride_tricks.sliding_window_view(x, spec.size)[:: spec.hop]
    w = window(spec.size, spec.periodic)
    return np.fft.rfft(frames * (w / w.sum() if spec.by_window else w), axis=1)


def log_mel(x: np.ndarray, spec: FeatureSpec, bank: np.ndarray | None = None) -> np.ndarray:
    """(frames, mels) as the spec scales them."""
    x = np.asarray(x, float)
    if spec.bank == "size" and len(x) <= spec.size:
        x = np.pad(x, (0, spec.size - len(x) + 1))
    s = np.abs(stft(x, spec))
    mel = (s if spec.magnitude else s * s) @ (filterbank(spec) if bank is None else bank).T
    if spec.scale == "centred":
        db = 10 * np.log10(mel + spec.eps)
        return np.clip((db - db.mean()) / 40, -1, 1) if db.size else db
    if spec.top_db is not None:
        db = 10 * np.log10(np.maximum(mel, spec.eps)) - 10 * np.log10(max(spec.eps, mel.max(initial=0)))
        db = np.maximum(db, db.max(initial=-np.inf) - spec.top_db)
    else:
        db = np.log(mel + spec.eps)
    if spec.frames is not None:
        if not len(db):
            return np.zeros((spec.frames, spec.mels))
        db = np.pad(db, ((0, max(0, spec.frames - len(db))), (0, 0)))[: spec.frames]
    low, high = (db.min(), db.max()) if db.size else (0.0, 0.0)
    return (db - low) / (high - low + spec.over) if high > low and high - low >= spec.flat else np.zeros_like(db)


def magnitude_column(frame: Column) -> Column:
    """Magnitude spectrum of a frame under a symmetric Hann window, over half the frame's length."""

    @F.arrow_udf("array<double>")
    def of(xs: pa.Array) -> pa.Array:
        out = []
        for x in xs.to_pylist():
            a = np.asarray(x or [], float)
            out.append((np.abs(np.fft.rfft(a * window(len(a), False)))[: len(a) // 2] / (len(a) / 2)).tolist() if len(a) > 1 else [])
        return pa.array(out, pa.list_(pa.float64()))

    return of(frame)


def log_mel_column(samples: Column, spec: FeatureSpec = SPEC_1) -> Column:
    """Feature matrix of each row's samples; null samples give null."""
    bank = filterbank(spec)

    @F.arrow_udf("array<array<double>>")
    def of(xs: pa.Array) -> pa.Array:
        return pa.array([None if x is None else log_mel(np.asarray(x), spec, bank).tolist() for x in xs.to_pylist()], pa.list_(pa.list_(pa.float64())))

    return of(samples)


def gcc_phat(left: np.ndarray, right: np.ndarray, most: int, rate: float = 16000, band: tuple[float, float] = (60.0, 3000.0), size: int = 512) -> tuple[float, float]:
    """Lag of the right channel in samples (with a parabola through the peak), and the peak over the next best more than a lag from it
    (inf if that isn't positive): the phase correlation of windowed frames within a band."""
    w = window(size, True)
    x = np.fft.rfft(np.asarray(right, float)[:size] * w[: len(right)], size) * np.conj(np.fft.rfft(np.asarray(left, float)[:size] * w[: len(left)], size))
    x = x / (np.abs(x) + 1e-12)
    hz = np.fft.rfftfreq(size, 1 / rate)
    x[(hz < band[0]) | (hz > band[1])] = 0
    c = np.fft.irfft(x, size)
    c = np.concatenate((c[-most:], c[: most + 1]))
    k = int(c.argmax())
    d = 0.0
    if 0 < k < len(c) - 1:
        a, b, e = c[k - 1 : k + 2]
        d = 0.5 * (a - e) / (a - 2 * b + e) if a - 2 * b + e < 0 else 0.0
    rest = np.delete(c, np.arange(max(0, k - 1), min(len(c), k + 2)))
    second = rest.max() if len(rest) else 0.0
    return k - most + d, float(c[k] / second) if second > 1e-9 else math.inf


def lag_column(left: Column, right: Column, most: int, rate: float = 16000, band: tuple[float, float] = (60.0, 3000.0), size: int = 512) -> Column:
    @F.arrow_udf("struct<lag: double, confidence: double>")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        got = [gcc_phat(np.asarray(x, float), np.asarray(y, float), most, rate, band, size) if x and y else (None, None) for x, y in zip(a.to_pylist(), b.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.float64()) for i in (0, 1)], names=["lag", "confidence"])

    return of(left, right)


def convolve_column(samples: Column, response: list[float]) -> Column:
    """Samples through an impulse response, cut to their length and brought back to their root mean square."""
    h = np.asarray(response, float)

    @F.arrow_udf("array<double>")
    def of(xs: pa.Array) -> pa.Array:
        out = []
        for x in xs.to_pylist():
            if not x:
                out.append(x)
                continue
            a = np.asarray(x, float)
            n = 1 << (len(a) + len(h) - 1).bit_length()
            y = np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(h, n), n)[: len(a)]
            out.append((y * np.sqrt((a * a).mean() / max((y * y).mean(), 1e-18))).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return of(samples)
