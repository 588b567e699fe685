"""Numeric functions with array-library semantics (half-even, NaN passes on) as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN = float("nan")


def log_or_inf(c: Column) -> Column:
    """Natural logarithm; -inf at zero and NaN below, where the built-in gives null."""
    return F.when(F.isnan(c), NAN).when(c > 0, F.ln(c)).when(c == 0, float("-inf")).when(c < 0, NAN)


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for divisor zero."""
    return a - b * F.floor(F.try_divide(a, b)).cast("double")


def trunc_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; null for divisor zero."""
    return F.try_mod(a, b)


def clip(c: Column, low: float, high: float) -> Column:
    """The value moved into [low, high]; NaN stays NaN, null stays null."""
    return F.when(F.isnan(c), NAN).when(c < low, low).when(c > high, high).otherwise(c)


def gauss(x: Column, mean: float, sigma: float) -> Column:
    z = (x - mean) / (sigma + 1e-12)
    return F.exp(z * z * -0.5)


def pulse(x: Column, period: float, duty: float) -> Column:
    """Square wave: 1 in the first ``duty`` of each period, else 0."""
    return F.when(floor_mod(x, F.lit(period)) < duty * period, 1.0).otherwise(0.0)


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = clip((x - low) / (high - low), 0.0, 1.0)
    return t * t * (t * -2.0 + 3.0)


def colormap(x: Column, points: list[tuple[float, int]]) -> Column:
    """Value between control points (place, level), clipped to their ends and truncated to whole levels."""
    t = clip(x, points[0][0], points[-1][0])
    out = F.lit(points[-1][1]).cast("double")
    for (a, u), (b, v) in reversed(list(zip(points, points[1:]))):
        out = F.when(t < b, (t - a) / (b - a) * float(v - u) + float(u)).otherwise(out)
    return F.floor(out).cast("int")


def fourier(x: Column, frequencies: tuple[int, ...]) -> Column:
    """[sin(2 pi f x), cos(2 pi f x), ...] over the frequencies."""
    import math

    return F.array(*[g(x * (2 * math.pi * f)) for f in frequencies for g in (F.sin, F.cos)])
