"""Geographic and image-geometry columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import EARTH_KM


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def dms_to_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds to signed decimal degrees; anything unreadable gives null."""
    deg, minute, sec = (c.try_cast("double") for c in (d, m, s))
    dec = deg + minute / 60 + sec / 3600
    return F.round(F.when(ref.isin("S", "W"), -dec).otherwise(dec), 6)


def shape_words(width: Column, height: Column) -> Column:
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    return (
        F.when((w > 0) & (F.abs(w - h) < 0.05 * F.greatest(w, h)), F.lit("square"))
        .when(h > w, F.lit("portrait vertical"))
        .otherwise(F.lit("landscape horizontal"))
    )
