"""Columns over the five axes: bounds, rounding, kernels, distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded by the one formula that both engines of the checks use."""
    return F.floor(_column(c) * 10**digits + 0.5001) / F.lit(float(10**digits))


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _column(c)))


def lerp(a: Column | str, b: Column | str, t: Column | float) -> Column:
    """Interpolation, clamped."""
    return clamp(_column(a) + (_column(b) - _column(a)) * t)


def kernel(value: Column | str, center: float, width: float) -> Column:
    """A Gaussian of height 1 by its width at half height; without width, equality."""
    value = _column(value)
    if width <= 1e-9:
        return (value == center).cast("double")
    return F.exp(-F.pow(value - center, 2) / (2 * (width / 2.35482) ** 2))


def total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def cosine(a: Sequence[str], b: Sequence[str]) -> Column:
    """Cosine of two vectors of columns, 0 if one has no length."""
    dot = total([F.col(x) * F.col(y) for x, y in zip(a, b)])
    both = F.sqrt(total([F.col(x) * F.col(x) for x in a])) * F.sqrt(total([F.col(y) * F.col(y) for y in b]))
    return F.when(both == 0, 0.0).otherwise(dot / both)


def or_default(c: Column | str, default: float) -> Column:
    """The default for nulls and for 0."""
    c = _column(c)
    return F.when(c.isNull() | (c == 0), default).otherwise(c)


def middle(low: Column | str, high: Column | str) -> Column:
    """The middle of a window."""
    return (_column(low) + _column(high)) / 2
