"""Distances, boxes and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radii in metres of the service and of the legacy tools, and metres a degree of latitude.
EARTH_M, LEGACY_EARTH_M, METERS_PER_DEGREE = 6_371_008.8, 6_371_000.0, 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres; the complement is kept from falling below zero."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    v = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * radius * F.atan2(F.sqrt(v), F.sqrt(F.greatest(F.lit(0.0), 1 - v)))


def lat_delta(radius_m: float) -> float:
    return radius_m / METERS_PER_DEGREE


def lon_delta(lat: Column, radius_m: float, pole: float = 1e-8) -> Column:
    """Half the box's width in degrees; the whole circle at the poles."""
    cosine = F.abs(F.cos(F.radians(lat)))
    return F.when(cosine < pole, 180.0).otherwise(F.least(F.lit(180.0), radius_m / (METERS_PER_DEGREE * cosine)))


def lon_apart(a: Column, b: Column) -> Column:
    """Difference of longitudes on the circle, 0 to 180."""
    d = F.abs(a - b)
    return F.least(d, 360 - d)


def cell_rows(lat: Column, radius_m: float) -> Column:
    return F.floor((lat + 90) / lat_delta(radius_m)).cast("long")


def cell_columns(lat_row: Column, lon: Column, radius_m: float) -> tuple[Column, Column]:
    """(column, columns) of a longitude in the grid row: cells are at least the radius wide anywhere in the row.

    Rows that come within a radius of a pole have one column.
    """
    d = lat_delta(radius_m)
    widest = F.greatest(F.abs(lat_row * d - 90), F.abs((lat_row + 1) * d - 90))  # the row's latitude nearest to a pole
    cosine = F.cos(F.radians(F.least(widest + d, F.lit(90.0))))
    count = F.when(cosine < 1e-6, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * METERS_PER_DEGREE * cosine / radius_m))).cast("long")
    return F.least(F.floor((lon + 180) / 360 * count), count - 1).cast("long"), count


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def iso6709(text: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of ``±lat±lon...``; null where it doesn't begin so."""
    pattern = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"
    return tuple(F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)
