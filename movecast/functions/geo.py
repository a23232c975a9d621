"""Great-circle column expressions (degrees in, metres / knots / degrees out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in metres, metres per nautical mile, milliseconds per hour.
EARTH_RADIUS_M = 6371000
METRES_PER_NAUTICAL_MILE = 1852.0
MS_PER_HOUR = 3600000.0


def _rad(deg: Column) -> Column:
    return deg * F.lit(math.pi / 180)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.sin(_rad(lat2 - lat1) / 2), F.sin(_rad(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def euclidean(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line distance in the units of the coordinates (fit for projected inputs)."""
    dlat, dlon = lat1 - lat2, lon1 - lon2
    return F.sqrt(dlat * dlat + dlon * dlon)


def speed_knots(metres: Column, dt_ms: Column) -> Column:
    """Speed over a leg in knots; -1 when time does not advance."""
    return F.when(
        dt_ms > 0, F.lit(MS_PER_HOUR) * metres / (F.lit(METRES_PER_NAUTICAL_MILE) * dt_ms)
    ).otherwise(F.lit(-1.0))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing of a leg, in [0, 360)."""
    lat1, lon1, lat2, lon2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    full = F.lit(2 * math.pi)
    return F.degrees((F.atan2(y, x) + full) % full)


def speed_error(speed: Column, threshold: Column | float) -> Column:
    """True for forecast speeds that are too high, NaN or infinite."""
    infinite = F.abs(speed) == F.lit(float("inf"))
    bound = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (speed > bound) | F.isnan(speed) | infinite
