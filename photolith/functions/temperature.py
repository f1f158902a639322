"""Colour temperature and tint, to and from chromaticity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of tint, and the range of the approximation of black bodies with its coefficients in descending powers.
TINT = 3000.0
COLDEST, HOTTEST = 1667.0, 25000.0
X_LOW, X_HIGH = (-0.2661239e9, -0.2343589e6, 0.8776956e3, 0.179910), (-3.0258469e9, 2.1070379e6, 0.2226347e3, 0.240390)
Y_LOW, Y_MID, Y_HIGH = (-1.1063814, -1.34811020, 2.18555832, -0.20219683), (-0.9549476, -1.37418593, 2.09137015, -0.16748867), (3.0817580, -5.87338670, 3.75112997, -0.37001483)
GOLDEN = 0.61803398875
STEPS = 60
#: So many rows are looked at side by side.
HELD = 2048


def _powers(x: Column, coefficients: tuple[float, ...]) -> Column:
    a, b, c, d = coefficients
    return ((a * x + b) * x + c) * x + d


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def to_uv(x: Column, y: Column) -> Column:
    under = -2 * x + 12 * y + 3
    return F.struct((4 * x / under).alias("u"), (6 * y / under).alias("v"))


def to_xy(u: Column, v: Column) -> Column:
    under = 2 * u - 8 * v + 4
    return F.struct((3 * u / under).alias("x"), (2 * v / under).alias("y"))


def _black_body(kelvin: Column) -> Column:
    k = F.greatest(F.lit(COLDEST), F.least(F.lit(HOTTEST), kelvin))
    x = F.when(k <= 4000, _powers(1 / k, X_LOW)).otherwise(_powers(1 / k, X_HIGH))
    return let(x, lambda x: to_uv(x, F.when(k <= 2222, _powers(x, Y_LOW)).when(k <= 4000, _powers(x, Y_MID)).otherwise(_powers(x, Y_HIGH))))


def locus(kelvin: Column) -> Column:
    """(u, v) of a black body; beyond the approximation's range along a line in reciprocal temperature."""
    k = F.greatest(F.lit(1000.0), kelvin)

    def along(a: float, b: float) -> Column:
        ends = F.struct(_black_body(F.lit(a)).alias("a"), _black_body(F.lit(b)).alias("b"))
        share = (1e6 / k - 1e6 / a) / (1e6 / b - 1e6 / a)
        at = lambda e, c: e["a"][c] + (e["b"][c] - e["a"][c]) * share
        return let(ends, lambda e: F.struct(at(e, "u").alias("u"), at(e, "v").alias("v")))

    return F.when(k < COLDEST, along(COLDEST, COLDEST + 50)).when(k > HOTTEST, along(HOTTEST - 500, HOTTEST)).otherwise(_black_body(k))


def _towards_green(kelvin: Column) -> Column:
    """The locus's unit normal of growing v."""
    mired = 1e6 / kelvin
    ends = F.struct(locus(1e6 / (mired + 1)).alias("a"), locus(1e6 / F.greatest(mired - 1, F.lit(1.0))).alias("b"))

    def normal(e: Column) -> Column:
        du, dv = e["b"]["u"] - e["a"]["u"], e["b"]["v"] - e["a"]["v"]
        length = F.greatest(F.hypot(du, dv), F.lit(1e-12))
        turn = F.when(du < 0, -1.0).otherwise(1.0)
        return F.struct((-dv / length * turn).alias("u"), (du / length * turn).alias("v"))

    return let(ends, normal)


def temperature_to_xy(kelvin: Column, tint: Column) -> Column:
    """(x, y) of the light that a temperature and a tint correct; a positive tint means a green light."""
    both = F.struct(locus(kelvin).alias("at"), _towards_green(kelvin).alias("n"))
    return let(both, lambda b: to_xy(b["at"]["u"] + b["n"]["u"] * tint / TINT, b["at"]["v"] + b["n"]["v"] * tint / TINT))


def _locus_of(kelvin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``locus`` of an array of temperatures."""

    def cubic(x: np.ndarray, c: tuple[float, ...]) -> np.ndarray:
        return ((c[0] * x + c[1]) * x + c[2]) * x + c[3]

    def black_body(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.where(k <= 4000, cubic(1 / k, X_LOW), cubic(1 / k, X_HIGH))
        y = np.where(k <= 2222, cubic(x, Y_LOW), np.where(k <= 4000, cubic(x, Y_MID), cubic(x, Y_HIGH)))
        under = -2 * x + 12 * y + 3
        return 4 * x / under, 6 * y / under

    k = np.maximum(1000.0, kelvin)
    u, v = black_body(np.clip(k, COLDEST, HOTTEST))
    for beyond, a, b in ((k < COLDEST, COLDEST, COLDEST + 50), (k > HOTTEST, HOTTEST - 500, HOTTEST)):
        if beyond.any():
            ends_u, ends_v = black_body(np.array([a, b]))
            share = (1e6 / k - 1e6 / a) / (1e6 / b - 1e6 / a)
            u = np.where(beyond, ends_u[0] + (ends_u[1] - ends_u[0]) * share, u)
            v = np.where(beyond, ends_v[0] + (ends_v[1] - ends_v[0]) * share, v)
    return u, v


def _nearest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kelvin, tint) of points of the plane."""

    def apart(mired: np.ndarray) -> np.ndarray:
        at_u, at_v = _locus_of(1e6 / mired)
        return (u - at_u) ** 2 + (v - at_v) ** 2

    steps = np.arange(20.0, 1001.0, 5.0)
    at_u, at_v = _locus_of(1e6 / steps)
    best = steps[((u[:, None] - at_u) ** 2 + (v[:, None] - at_v) ** 2).argmin(1)]
    a, b = np.maximum(best - 5, 20.0), np.minimum(best + 5, 1000.0)
    for _ in range(STEPS):
        c, d = b - GOLDEN * (b - a), a + GOLDEN * (b - a)
        left = apart(c) < apart(d)
        a, b = np.where(left, a, c), np.where(left, d, b)
    kelvin = 2e6 / (a + b)
    at_u, at_v = _locus_of(kelvin)
    mired = 1e6 / kelvin
    (u0, v0), (u1, v1) = _locus_of(1e6 / (mired + 1)), _locus_of(1e6 / np.maximum(mired - 1, 1.0))
    du, dv = u1 - u0, v1 - v0
    length, turn = np.maximum(np.hypot(du, dv), 1e-12), np.where(du < 0, -1.0, 1.0)
    return kelvin, ((u - at_u) * (-dv / length * turn) + (v - at_v) * (du / length * turn)) * TINT


def xy_to_temperature(x: Column, y: Column) -> Column:
    """(kelvin, tint): the nearest temperature of the locus, by a scan in steps of 5 mired from 20 to 1000 and a golden
    section around the best, and the distance from there; null without a finite (u, v).

    These are over 300 places of the locus a row, so they are worked out for many rows at once."""

    @F.pandas_udf("kelvin double, tint double")
    def find(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = np.full((len(u), 2), np.nan)
        points = np.column_stack([u, v]).astype(float)
        usable = np.flatnonzero(np.isfinite(points).all(1))
        for k in range(0, len(usable), HELD):
            at = usable[k : k + HELD]
            out[at] = np.column_stack(_nearest(points[at, 0], points[at, 1]))
        found = pd.DataFrame(out, columns=["kelvin", "tint"])
        return found.astype(object).where(found.notna(), None)

    uv = to_uv(x, y)
    return find(uv["u"], uv["v"])
