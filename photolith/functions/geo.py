"""Positions: distances, map projection, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
MAX_LAT = 85.0511287798066


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def normalize_lon(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def project(lat: Column, lon: Column, zoom: float) -> tuple[Column, Column]:
    """Web Mercator pixels of a world that is 256 * 2^zoom wide."""
    size = 256.0 * 2**zoom
    s = F.sin(F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))))
    return (lon + 180) / 360 * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * size


def unproject(x: Column, y: Column, zoom: float) -> tuple[Column, Column]:
    size = 256.0 * 2**zoom
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / size)))), x / size * 360 - 180


def metres_per_pixel(lat: Column, zoom: float) -> Column:
    return F.cos(F.radians(lat)) * (2 * 3.141592653589793 * EARTH_M / (256.0 * 2**zoom))


def parse_position(text: Column) -> Column:
    """``lat, lon`` as typed -> struct, or null if it isn't one on earth."""
    parts = F.split(text, ",")
    lat, lon = parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    good = (F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))
