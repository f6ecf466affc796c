"""Random numbers by counter, and synthetic signals made of them: sample i of a row is a function of (seed, row, i), so that any part of a signal
can be made anywhere and is the same under any partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of the pink noise: unit k is drawn anew every 2 ** (k + 1) samples.
UNITS = 8
#: The largest value of |pink|, about: 8 units and the white part are 0.1 times a normal each, and one sample in a million is beyond.
PINK_PEAK = 1.5
FAMILIES = ("white", "pink", "tone_1000", "tone_100", "sweep", "speech")


def bits(seed: int, stream: int, i: np.ndarray) -> np.ndarray:
    """64 random bits for each counter."""
    with np.errstate(over="ignore"):
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + stream * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
        h = i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(mult)
        return h ^ (h >> np.uint64(31))


def uniforms(seed: int, stream: int, i: np.ndarray) -> np.ndarray:
    return ((bits(seed, stream, i) >> np.uint64(11)) + 0.5) / float(1 << 53)


def normals(seed: int, stream: int, i: np.ndarray) -> np.ndarray:
    i = np.asarray(i, np.int64)
    return np.sqrt(-2 * np.log(uniforms(seed, 2 * stream, i))) * np.cos(2 * np.pi * uniforms(seed, 2 * stream + 1, i))


def pink(seed: int, i: np.ndarray) -> np.ndarray:
    """Pink noise at the places i: the sum of UNITS values of which the k-th belongs to i >> (k + 1), and a white one."""
    i = np.asarray(i, np.int64)
    out = normals(seed, UNITS, i)
    for k in range(UNITS):
        out = out + normals(seed, k, i >> (k + 1))
    return 0.1 * out / PINK_PEAK


def voiced(seed: int, i: np.ndarray, rate: int) -> np.ndarray:
    """A low tone at about 80 Hz (50 at least) with two overtones and vibrato, a slow rise and fall, noise and a loudness of its own, within -1 and 1."""
    one = np.zeros(1, np.int64)
    draw = lambda k: float(uniforms(seed, 100 + k, one)[0])
    t = np.asarray(i, np.int64) / rate
    f = max(50.0, 80 + 20 * float(normals(seed, 90, one)[0]))
    phase = 2 * np.pi * f * t * (1 + 0.1 * np.sin(2 * np.pi * 5 * t))
    out = sum(np.sin(k * phase) / k for k in (1, 2, 3))
    out = out * (0.5 + 0.5 * np.sin(2 * np.pi * (0.15 + 0.15 * draw(0)) * t + 2 * np.pi * draw(1)))
    out = out + (0.1 + 0.2 * draw(2)) * normals(seed, 91, i)
    return np.clip(out * (0.3 + 0.5 * draw(3)), -1, 1)


def of_family(family: str, seed: int, i: np.ndarray, rate: int) -> np.ndarray:
    """Noise of one of FAMILIES; speech is noise whose loudness beats at 4 to 8 Hz, a sweep goes from 200 to 2,000 Hz in each second."""
    i = np.asarray(i, np.int64)
    t = i / rate
    if family == "white":
        out = 0.3 * normals(seed, 92, i)
    elif family == "pink":
        out = 0.3 * pink(seed, i)
    elif family.startswith("tone_"):
        out = 0.5 * np.sin(2 * np.pi * float(family[5:]) * t)
    elif family == "sweep":
        s = t % 1.0
        out = 0.3 * np.sin(2 * np.pi * (200 * s + 900 * s * s))
    elif family == "speech":
        beat = 4 + 4 * float(uniforms(seed, 95, np.zeros(1, np.int64))[0])
        out = 0.5 * normals(seed, 93, i) * (0.3 + 0.7 * np.abs(np.sin(2 * np.pi * beat * t)))
    else:
        raise ValueError(family)
    return np.clip(out * (0.2 + 0.6 * float(uniforms(seed, 94, np.zeros(1, np.int64))[0])), -1, 1)


def _column(make, seed: int, *columns: Column) -> Column:
    """Each row's samples: make(values of the columns, row seed, places)."""

    @F.arrow_udf("array<double>")
    def of(*arrays: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(a.to_pylist() for a in arrays)):
            out.append(None if None in row else make(row[3:], seed * 1_000_003 + row[0], np.arange(row[1], row[1] + row[2])))
        return pa.array(out, pa.list_(pa.float64()))

    return of(*columns)


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def pink_column(id: Column, n, seed: int = 0, first=0) -> Column:
    """Samples first to first + n - 1 of a row's pink noise."""
    return _column(lambda _, s, i: pink(s, i), seed, _long(id), _long(first), _long(n))


def voiced_column(id: Column, n, rate: int, seed: int = 0, first=0) -> Column:
    return _column(lambda _, s, i: voiced(s, i, rate), seed, _long(id), _long(first), _long(n))


def noise_column(id: Column, family: Column, n, rate: int, seed: int = 0, first=0) -> Column:
    return _column(lambda v, s, i: of_family(v[0], s, i, rate), seed, _long(id), _long(first), _long(n), family)
