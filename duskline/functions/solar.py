"""Apparent sunrise and sunset from the public NOAA low-accuracy equations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskline.functions.timeparts import _col

# NOAA equation-of-time and declination coefficients, and the
# apparent zenith in degrees.
EQ_TIME = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
ZENITH_DEG = 90.833


def _solar_minutes(day, lat: float, lon: float, rising: bool) -> Column:
    g = (F.dayofyear(_col(day)) - F.lit(1)).cast("double") * F.lit(2 * math.pi / 365)
    e, d = EQ_TIME, DECLINATION
    eq = F.lit(229.18) * (
        F.lit(e[0]) + F.lit(e[1]) * F.cos(g) + F.lit(e[2]) * F.sin(g)
        + F.lit(e[3]) * F.cos(g * 2) + F.lit(e[4]) * F.sin(g * 2)
    )
    decl = (
        F.lit(d[0]) + F.lit(d[1]) * F.cos(g) + F.lit(d[2]) * F.sin(g)
        + F.lit(d[3]) * F.cos(g * 2) + F.lit(d[4]) * F.sin(g * 2)
        + F.lit(d[5]) * F.cos(g * 3) + F.lit(d[6]) * F.sin(g * 3)
    )
    phi = math.radians(lat)
    cos_ha = F.lit(math.cos(math.radians(ZENITH_DEG)) / math.cos(phi)) / F.cos(decl) - F.lit(math.tan(phi)) * F.tan(decl)
    ha = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_ha))))
    return F.lit(720.0) - F.lit(4.0) * (F.lit(lon) + (ha if rising else -ha)) - eq


def sunset_utc_hours(day, lat: float, lon: float) -> Column:
    """Hours after UTC midnight of the date at which the sun sets."""
    return _solar_minutes(day, lat, lon, rising=False) / F.lit(60.0)


def sunrise_utc_hours(day, lat: float, lon: float) -> Column:
    return _solar_minutes(day, lat, lon, rising=True) / F.lit(60.0)


def sunset_utc(day, lat: float, lon: float) -> Column:
    """Sunset as a UTC timestamp."""
    micros = F.round(_solar_minutes(day, lat, lon, rising=False) * F.lit(60_000_000.0), 0).cast("long")
    return F.timestamp_add("MICROSECOND", micros, _col(day).cast("timestamp_ntz"))


def night_length_hours(day, lat: float, lon: float) -> Column:
    """Sunset to next sunrise."""
    nxt = F.date_add(_col(day), 1)
    return F.lit(24.0) + sunrise_utc_hours(nxt, lat, lon) - sunset_utc_hours(day, lat, lon)
