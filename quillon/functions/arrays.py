"""Scalar and array functions as column expressions: they stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(x: Column) -> Column:
    return F.size(x)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once; inside another lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / _n(x)


def mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / _n(x)


def rms(x: Column) -> Column:
    return F.sqrt(mean_square(x))


def rms_db(x: Column, inner: float = 1e-10, outer: float = 1e-10) -> Column:
    return 20 * F.log10(F.sqrt(mean_square(x) + inner) + outer)


def to_db(x: Column, eps: float = 1e-10) -> Column:
    return 20 * F.log10(x + eps)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def deviation(x: Column) -> Column:
    return let(mean(x), lambda m: F.sqrt(F.greatest(F.lit(0.0), mean_square(x) - m * m)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.transform(x, lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def minmax(x: Column, eps: float = 0.0) -> Column:
    """Scaled to 0..1; a flat array gives zeros."""
    scaled = lambda b: F.transform(x, lambda v: F.when(b["high"] - b["low"] + eps > 0, (v - b["low"]) / (b["high"] - b["low"] + eps)).otherwise(0.0))
    return let(F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high")), scaled)


def centre_clip(x: Column, scale: float) -> Column:
    """(v - mean) / scale within -1..1"""
    return let(mean(x), lambda m: F.transform(x, lambda v: F.least(F.greatest((v - m) / scale, F.lit(-1.0)), F.lit(1.0))))


def quantise(x: Column, scale: float, zero: int, truncate: bool = False) -> Column:
    """int8 values; rounds half to even, or truncates."""
    r = (lambda v: v.cast("int")) if truncate else F.rint
    return F.transform(x, lambda v: F.least(F.greatest(r(v / scale + zero) if truncate else r(v / scale) + zero, F.lit(-128)), F.lit(127)).cast("int"))


def dequantise(q: Column, scale: float, zero: int) -> Column:
    return F.transform(q, lambda v: (v - zero) * scale)


def to_pcm(x: Column) -> Column:
    """Floats in -1..1 to 16 bits: times 32767, half to even."""
    return F.transform(x, lambda v: F.rint(F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int"))


def from_pcm(x: Column) -> Column:
    return F.transform(x, lambda v: v / 32768.0)


def shift(x: Column, n: int) -> Column:
    """Moved by n places (to the right if positive), zeros filled in."""
    k = min(abs(n), 1 << 30)
    zeros = F.array_repeat(F.lit(0.0), k)
    return F.slice(F.concat(zeros, x), 1, _n(x)) if n >= 0 else F.slice(F.concat(F.slice(x, k + 1, F.greatest(_n(x) - k, F.lit(0))), zeros), 1, _n(x))


def roll(x: Column, n: int) -> Column:
    """Moved round by n places."""
    return F.transform(x, lambda v, i: F.get(x, F.pmod(i - n, _n(x)).cast("int")))


def gain_db(x: Column, db: float) -> Column:
    return clip(F.transform(x, lambda v: v * 10 ** (db / 20)), -1.0, 1.0)


def scale_to_rms(x: Column, target: float) -> Column:
    return let(rms(x), lambda r: F.transform(x, lambda v: v * target / F.greatest(r, F.lit(1e-9))))


def mix_at_snr(x: Column, noise: Column, db: float) -> Column:
    """x plus noise scaled so that the ratio of their root mean squares is db."""
    ratio = rms(x) / (F.greatest(rms(noise), F.lit(1e-9)) * 10 ** (db / 20))
    return let(ratio, lambda k: F.zip_with(x, noise, lambda a, b: a + k * b))


def tilt(x: Column, a: float) -> Column:
    """One-pole low-pass: y[i] = a * x[i] + (1 - a) * y[i - 1]."""
    step = lambda acc, v: F.concat(acc, F.array(a * v + (1 - a) * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))))
    return F.aggregate(x, F.array().cast("array<double>"), step)


def mask(x: Column, start: Column, width: Column) -> Column:
    return F.transform(x, lambda v, i: F.when((i >= start) & (i < start + width), 0.0).otherwise(v))


def add_noise(x: Column, level: float, *seed) -> Column:
    """Noise of a normal shape from hashes, times level times the array's deviation."""
    from quillon.functions.hashing import uniform

    near = lambda i: sum((uniform(*seed, i, k) for k in range(4)), F.lit(-2.0)) * 3**0.5  # noqa: E731  sum of four uniforms
    return let(deviation(x), lambda d: F.transform(x, lambda v, i: v + level * d * near(i)))


def pad_centre(x: Column, n: int) -> Column:
    """The middle n values, or zeros on both sides."""
    cut = F.slice(x, F.floor((_n(x) - n) / 2).cast("int") + 1, n)
    left = F.floor((n - _n(x)) / 2).cast("int")
    padded = F.concat(F.array_repeat(F.lit(0.0), left), x, F.array_repeat(F.lit(0.0), n - _n(x) - left))
    return F.when(_n(x) >= n, cut).otherwise(padded)


def fit_window(x: Column, offset: Column, n: int) -> Column:
    """n values from the offset (from 0), zeros on the right."""
    part = F.slice(x, offset + 1, n)
    return F.slice(F.concat(part, F.array_repeat(F.lit(0.0), n)), 1, n)


def centre_offset(x: Column, n: int) -> Column:
    return F.greatest(F.floor((_n(x) - n) / 2), F.lit(0)).cast("int")


def clip_offset(offset: Column, x: Column, n: int) -> Column:
    return F.greatest(F.least(offset, _n(x) - n), F.lit(0)).cast("int")


def frames(x: Column, size: int, hop: int) -> Column:
    """Full frames, overlapping if hop < size."""
    count = F.floor((_n(x) - size) / hop).cast("int") + 1
    return F.when(_n(x) >= size, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(x, i * hop + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def argmax(x: Column) -> Column:
    """The first place (from 0) of the largest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def band_ratio(mag: Column, rate: float, low: float = 60.0, high: float = 600.0) -> Column:
    """Energy of a magnitude spectrum within a band over all, without the first bin; 0 if there is next to none."""
    hz = rate / 2 / _n(mag)
    power = F.transform(mag, lambda v, i: F.when(i > 0, v * v).otherwise(0.0))
    band = F.aggregate(F.transform(mag, lambda v, i: F.when((i >= F.greatest(F.floor(low / hz), F.lit(1))) & (i <= F.floor(high / hz)), v * v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    whole = total(power)
    return F.when(whole < 1e-12, 0.0).otherwise(band / whole)


def fundamental(mag: Column, rate: float, low: float = 60.0, high: float = 600.0) -> Column:
    hz = rate / 2 / _n(mag)
    own = F.transform(mag, lambda v, i: F.when((i >= F.greatest(F.floor(low / hz), F.lit(1))) & (i <= F.floor(high / hz)), v).otherwise(-1.0))
    return argmax(own) * hz


def hz_to_mel(x: Column) -> Column:
    return 2595 * F.log10(1 + x / 700)


def mel_to_hz(x: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), x / 2595) - 1)


def hann(n: int) -> Column:
    """Periodic Hann window."""
    import math

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.5 - 0.5 * F.cos(i * (2 * math.pi / n)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def saturated_sigmoid(x: Column, at: float = 10.0) -> Column:
    return F.when(x > at, 1.0).when(x < -at, 0.0).otherwise(sigmoid(x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(p / (1 - p))


def platt(z: Column, a: float, b: float) -> Column:
    return sigmoid(a * z + b)


def audit_flag(y: Column, p: Column, weak: float = 0.02, strong: float = 0.5) -> Column:
    return F.when((y == 1) & (p < weak), "weak_positive").when((y == 0) & (p > strong), "snore_in_negative").otherwise("")


def intensity(level: Column) -> Column:
    """Levels 1..3 (clamped) to 0.2, 0.4, 0.7."""
    return F.element_at(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.7)), F.least(F.greatest(level, F.lit(1)), F.lit(3)).cast("int"))


def side(lag: Column, dead: float) -> Column:
    return F.when(lag > dead, "left").when(lag < -dead, "right").otherwise("unknown")


def max_lag(spacing_m: float, rate: int, speed: float = 343.0) -> int:
    import math

    return math.ceil(spacing_m / speed * rate) + 1


def to_ticks(seconds: Column, tick_ms: int) -> Column:
    return F.rint(seconds * 1000 / tick_ms).cast("long")


def tick_end(tick: Column, tick_s: float = 0.5) -> Column:
    """When the one-second window of a tick ends."""
    return (tick + 2) * tick_s
