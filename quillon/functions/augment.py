"""Augmentation of samples and feature matrices, drawn from hashes of a key: the same key gives the same result on any cluster."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions.hashing import uniform


@dataclass(frozen=True)
class Chain:
    """Chances and ranges of the steps, in the order in which they come."""

    p_response: float = 0.6
    p_noise_pos: float = 0.7
    p_noise_neg: float = 0.4
    snr: tuple[float, float] = (-5.0, 20.0)
    p_tilt: float = 0.3
    tilt: tuple[float, float] = (-0.5, 0.5)
    p_shift: float = 0.5
    shift: int = 1600
    p_gain: float = 0.3
    gain: tuple[float, float] = (-12.0, 6.0)
    p_mask: float = 0.5
    mask_bands: int = 4
    mask_frames: int = 8


def within(u: Column, low: float, high: float) -> Column:
    return F.lit(low) + u * (high - low)


def volume(x: Column, seed: int, key: Column, low: float = 0.7, high: float = 1.3) -> Column:
    """Samples times a factor drawn for the key, within -1 and 1."""
    factor = within(uniform(seed, key), low, high)
    return A.let(F.struct(x.alias("x"), factor.alias("f")), lambda s: F.transform(s["x"], lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * s["f"]))))


def random_offset(n: Column, width: int, seed: int, key: Column) -> Column:
    """A place where a window of width may begin in n samples (0 if it is longer)."""
    return F.floor(uniform(seed, key) * (F.greatest(n - width, F.lit(0)) + 1)).cast("long")


def tilted(x: np.ndarray, a: float) -> np.ndarray:
    """First-order filter y[i] = x[i] + a x[i - 1], brought back to the root mean square of x."""
    y = x + a * np.concatenate(([0.0], x[:-1]))
    return y * np.sqrt((x * x).mean() / max((y * y).mean(), 1e-18))


def chain_step(x: np.ndarray, noise: np.ndarray | None, response: np.ndarray | None, label: int, u: list[float], c: Chain) -> np.ndarray:
    """Response, noise, tilt, shift, gain: u holds a draw for each chance and one for each amount."""
    draw = lambda k, r: r[0] + u[k] * (r[1] - r[0])
    y = x
    if response is not None and u[0] < c.p_response:
        y = np.convolve(y, response)[: len(x)]
        y = y * np.sqrt((x * x).mean() / max((y * y).mean(), 1e-18))
    if noise is not None and u[1] < (c.p_noise_pos if label == 1 else c.p_noise_neg):
        power = np.sqrt((y * y).mean()) / (max(np.sqrt((noise * noise).mean()), 1e-9) * 10 ** (draw(2, c.snr) / 20))
        y = y + power * np.resize(noise, len(y))
    if u[3] < c.p_tilt:
        y = tilted(y, draw(4, c.tilt))
    if u[5] < c.p_shift:
        k = int(np.floor(-c.shift + u[6] * (2 * c.shift + 1)))
        y = np.concatenate((np.zeros(min(k, len(y))), y[: max(0, len(y) - k)])) if k >= 0 else np.concatenate((y[-k:], np.zeros(min(-k, len(y)))))
    if u[7] < c.p_gain:
        y = np.clip(y * 10 ** (draw(8, c.gain) / 20), -1, 1)
    return y


def chain(x: Column, label: Column, seed: int, key: Column, noise: Column | None = None, responses: list[list[float]] | None = None, c: Chain = Chain()) -> Column:
    """The chain on each row's samples. noise: samples to mix in (joined before, as by a noise pick); responses: a bank of impulse responses, one
    of which is picked for each key. It is part of the plan, so it has to be small, as banks of room responses are."""
    bank = [np.asarray(r, float) for r in responses or []]
    u = F.array(*[uniform(seed + k, key) for k in range(10)])

    @F.arrow_udf("array<double>")
    def of(xs: pa.Array, ns: pa.Array, labels: pa.Array, us: pa.Array) -> pa.Array:
        out = []
        for a, n, y, d in zip(xs.to_pylist(), ns.to_pylist(), labels.to_pylist(), us.to_pylist()):
            pick = bank[min(int(d[9] * len(bank)), len(bank) - 1)] if bank else None
            out.append(a if not a else chain_step(np.asarray(a, float), np.asarray(n, float) if n else None, pick, y, d, c).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return of(x, F.lit(None).cast("array<double>") if noise is None else noise, label, u)


def feature_mask(x: Column, seed: int, key: Column, c: Chain = Chain()) -> Column:
    """The end of the chain, on feature matrices (arrays of frames): with a chance, one stretch of bands and one of frames are set to 0. Each has a drawn width
    from 1 up to a most, and a drawn place; a matrix with fewer is masked whole in that direction. Null and empty matrices stay."""
    u = lambda k: uniform(seed + k, key)
    width = lambda k, most: 1 + F.floor(u(k) * most)
    place = lambda k, n, w: F.floor(u(k) * (F.greatest(n - w, F.lit(0)) + 1))
    sizes = F.struct(x.alias("x"), u(0).alias("u"), width(1, c.mask_bands).alias("w"), width(2, c.mask_frames).alias("h"), F.size(x).alias("rows"), F.coalesce(F.size(F.get(x, F.lit(0))), F.lit(0)).alias("columns"))
    drawn = lambda s: F.struct(s["x"].alias("x"), s["u"].alias("u"), s["w"].alias("w"), s["h"].alias("h"), place(3, s["columns"], s["w"]).alias("a"), place(4, s["rows"], s["h"]).alias("b"))

    def masked(s: Column) -> Column:
        cell = lambda v, i, j: F.when(((j >= s["a"]) & (j < s["a"] + s["w"])) | ((i >= s["b"]) & (i < s["b"] + s["h"])), 0.0).otherwise(v)
        return F.when(s["u"] < c.p_mask, F.transform(s["x"], lambda row, i: F.transform(row, lambda v, j: cell(v, i, j)))).otherwise(s["x"])

    return A.let(sizes, lambda s: A.let(drawn(s), masked))


def batch_matrix(x: Column, place: Column, size: Column, seed: int, key: Column, deviation: float = 0.02) -> Column:
    """A feature matrix (array of frames) by its place in its batch: the first half is shifted by -5 to 4 frames, of the first third 2 to 5 bands
    are set to 0, and all get noise and are held within 0 and 1."""
    shift = F.when(place < F.floor(size / 2), F.floor(uniform(seed, key) * 10) - 5).otherwise(0)
    first = F.when(place < F.floor(size / 3), F.floor(uniform(seed + 1, key) * 20)).otherwise(-1)
    width = F.floor(uniform(seed + 2, key) * 4) + 2

    @F.arrow_udf("array<array<double>>")
    def of(xs: pa.Array, shifts: pa.Array, firsts: pa.Array, widths: pa.Array, seeds: pa.Array) -> pa.Array:
        out = []
        for a, s, f, w, n in zip(*(v.to_pylist() for v in (xs, shifts, firsts, widths, seeds))):
            if not a:
                out.append(a)
                continue
            m = np.asarray(a, float)
            moved = np.zeros_like(m)
            if s >= 0:
                moved[s:] = m[: len(m) - s]
            else:
                moved[:s] = m[-s:]
            if f >= 0:
                moved[:, f : f + w] = 0
            out.append(np.clip(moved + np.random.default_rng(n).normal(0, deviation, m.shape), 0, 1).tolist())
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return of(x, shift.cast("long"), first.cast("long"), width.cast("long"), F.floor(uniform(seed + 3, key) * (1 << 31)).cast("long"))


def equal_width_bands(magnitude: Column, bands: int, low: int, high: int) -> Column:
    """Means of equal runs of bins between two bins, their logarithms scaled to 0 to 1 (a range below 0.01 counts as 1)."""
    width = max(1, (high - low) // bands)
    sums = lambda x: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda m: A.total(F.slice(x, m * width + low + 1, width)) / width)
    logs = lambda x: F.transform(sums(x), lambda v: F.log(v + 1e-6))
    span = lambda y: F.when(F.array_max(y) - F.array_min(y) < 0.01, F.lit(1.0)).otherwise(F.array_max(y) - F.array_min(y))
    scaled = lambda y: A.let(F.struct(y.alias("y"), F.array_min(y).alias("low"), span(y).alias("span")), lambda s: F.transform(s["y"], lambda v: (v - s["low"]) / s["span"]))
    return A.let(magnitude, lambda x: A.let(logs(x), scaled))


def samples_from_words(x: Column) -> Column:
    """16-bit samples from 32-bit words whose upper half holds them."""
    return F.transform(x, lambda v: F.shiftright(v, 16).cast("short"))
