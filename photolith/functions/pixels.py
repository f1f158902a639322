"""Measures of small images kept as arrays, and colour formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photolith.functions.temperature import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def signature(values: Column) -> Column:
    """Zero mean and unit length; null for a flat image. Mean and length are worked out once, not for each pixel."""

    def scaled(centred: Column) -> Column:
        length = F.sqrt(_sum(F.transform(centred, lambda x: x * x)))
        return let(length, lambda length: F.when(length > 1e-12, F.transform(centred, lambda x: x / length)))

    def centred(v: Column) -> Column:
        return let(_sum(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))

    return let(F.transform(values, lambda x: x.cast("double")), lambda v: let(centred(v), scaled))


def laplacian_energy(values: Column, side: int) -> Column:
    """Mean squared difference of the inner pixels to their four neighbours' mean, of a square image."""
    inner = [r * side + c for r in range(1, side - 1) for c in range(1, side - 1)]
    at = lambda k: values[k].cast("double")
    parts = [F.pow(at(k) - (at(k - 1) + at(k + 1) + at(k - side) + at(k + side)) / 4, F.lit(2.0)) for k in inner]
    return _sum(F.array(*parts)) / len(inner)


def clipped(values: Column, low: float, high: float) -> Column:
    """The share of pixels at or beyond either end."""
    return F.size(F.filter(values, lambda x: (x <= low) | (x >= high))) / F.size(values)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees (0 for greys), saturation and value of a colour between 0 and 1."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    span = most - least
    turn = F.when(span == 0, 0.0).when(most == r, F.pmod((g - b) / span, F.lit(6.0))).when(most == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return turn * 60, F.when(most > 0, span / most).otherwise(0.0), most


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue as in ``hsv``, saturation and lightness."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    light = (most + least) / 2
    round_ = 1 - F.abs(2 * light - 1)
    return hsv(r, g, b)[0], F.when(round_ > 0, (most - least) / round_).otherwise(0.0), light


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Linear sRGB to Oklab, by the published matrices."""
    root = lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(1 / 3))
    l_ = root(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b)
    m_ = root(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b)
    s_ = root(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b)
    return (
        0.2104542553 * l_ + 0.7936177850 * m_ - 0.0040720468 * s_,
        1.9779984951 * l_ - 2.4285922050 * m_ + 0.4505937099 * s_,
        0.0259040371 * l_ + 0.7827717662 * m_ - 0.8086757660 * s_,
    )
