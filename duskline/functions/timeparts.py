"""Event-time alignment as column expressions.

All timestamps are TIMESTAMP_NTZ read as UTC, and local wall clock is also
TIMESTAMP_NTZ. The session time zone must be UTC (get_session sets it):
Spark takes differences of such timestamps through the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_local(ts, tz: str) -> Column:
    """UTC wall clock to local wall clock, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts))


def night_date(ts, start_hour: int) -> Column:
    """Evening date of the night: the date itself from start_hour on, else the day before."""
    ts = _col(ts)
    day = F.to_date(ts)
    return F.when(F.hour(ts) >= start_hour, day).otherwise(F.date_sub(day, 1))


def in_hours(ts, start: int, end: int, closed: bool = False) -> Column:
    """Hour window. start > end wraps past midnight; closed also admits exactly end:00."""
    ts = _col(ts)
    h = F.hour(ts)
    inside = ((h >= start) | (h < end)) if start > end else ((h >= start) & (h < end))
    if closed:
        inside = inside | ((h == end) & (F.minute(ts) == 0) & (F.second(ts) == 0))
    return inside


def in_season(day, months, years=None) -> Column:
    """Season filter on the night label."""
    day = _col(day)
    keep = F.month(day).isin(list(months))
    return keep if years is None else keep & F.year(day).isin(list(years))


def shift_minutes(ts, minutes: float) -> Column:
    """Move a timestamp by a (possibly fractional) number of minutes."""
    return F.timestamp_add("MICROSECOND", F.lit(int(round(minutes * 60_000_000))).cast("long"), _col(ts))


def midpoint(ts, width_minutes: float = 15.0) -> Column:
    """Interval-end label to interval midpoint."""
    return shift_minutes(ts, -width_minutes / 2)


def hours_since(ts, ref) -> Column:
    """Signed hours from ref to ts."""
    return F.timestamp_diff("MICROSECOND", _col(ref), _col(ts)).cast("double") / F.lit(3.6e9)


def snap(x, per_unit: int = 4) -> Column:
    """Round to the nearest 1/per_unit, halves to even."""
    return F.bround(_col(x) * F.lit(float(per_unit)), 0) / F.lit(float(per_unit))


def floor_hour(ts) -> Column:
    base = F.expr(EPOCH)
    return F.timestamp_add("HOUR", F.timestamp_diff("HOUR", base, _col(ts)), base)


def ceil_hour(ts) -> Column:
    """Hour-end label of a timestamp; a timestamp on the hour keeps its own label."""
    ts = _col(ts)
    down = floor_hour(ts)
    return F.when(down == ts, down).otherwise(F.timestamp_add("HOUR", F.lit(1), down))


def fractional_hour(ts) -> Column:
    ts = _col(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def date_parts(day: str) -> dict[str, Column]:
    d = _col(day)
    return {"year": F.year(d), "month": F.month(d), "doy": F.dayofyear(d)}


def season_terms(doy) -> tuple[Column, Column]:
    """Centred, scaled day of year and its square."""
    s = (_col(doy).cast("double") - F.lit(196.5)) / F.lit(30.0)
    return s, s * s
