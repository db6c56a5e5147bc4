"""Distances on the sphere and longitude handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.19

__all__ = [
    "EARTH_RADIUS_KM", "KM_PER_DEGREE", "haversine_km", "unit_xyz", "chord_from_km",
    "km_from_chord", "wrap_lon", "planar_deg2",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in km; the root argument is clamped to [0, 1]."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def planar_deg2(lon1, lat1, lon2, lat2) -> Column:
    """Squared planar distance in degrees: no cos(lat), no dateline wrap."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    return (lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    lat, lon = F.radians(_col(lat)), F.radians(_col(lon))
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def chord_from_km(km) -> Column:
    return 2 * F.sin(_col(km) / (2 * EARTH_RADIUS_KM))


def km_from_chord(chord) -> Column:
    half = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(chord) / 2))
    return 2 * EARTH_RADIUS_KM * F.asin(half)


def wrap_lon(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_col(lon) + 180.0, F.lit(360.0)) - 180.0
