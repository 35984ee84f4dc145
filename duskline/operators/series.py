"""Ordered-series operators: windows along time or bins.

Each window runs inside one short series (a station's years, a night's bins),
so partitions are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.functions import timeparts as tp
from duskline.functions.numeric import safe_div


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def yearly_shift(df: DataFrame, unit: str, year: str, value: str, n: str, min_n: int = 30, step: float = 0.5) -> DataFrame:
    """Change from the previous available year, and a step flag for well-observed consecutive years."""
    w = W.partitionBy(unit).orderBy(year)
    out = df.withColumns({
        "previous_year": F.lag(year).over(w), "previous_n": F.lag(n).over(w),
        "change": F.col(value) - F.lag(value).over(w)})
    consecutive = F.coalesce(F.col(year) - F.col("previous_year") == 1, F.lit(False))
    well = consecutive & (F.col(n) >= min_n) & (F.col("previous_n") >= min_n)
    return out.withColumns({
        "consecutive": consecutive, "well_observed": well,
        "step_change": well & (F.abs("change") >= step)})


def bin_rate(df: DataFrame, by, x: str, y: str, per_unit: float = 4.0) -> DataFrame:
    """Rate between neighbouring bins, positive when the value falls."""
    w = W.partitionBy(*_list(by)).orderBy(x)
    return df.withColumn("rate", -(F.col(y) - F.lag(y).over(w)) * F.lit(per_unit))


def complete(df: DataFrame, by, x: str, lo: float, hi: float, step: float = 0.25) -> DataFrame:
    """Whether each group has exactly the bins lo, lo+step, ..., hi."""
    expected = int(round((hi - lo) / step)) + 1
    inside = df.where(F.col(x).between(lo, hi))
    return inside.groupBy(*_list(by)).agg(F.count("*").alias("n_bins")).withColumn(
        "complete", F.col("n_bins") == expected)


def trapezoid(df: DataFrame, by, x: str, y: str, out: str = "integral") -> DataFrame:
    """Trapezoid integral along x."""
    by = _list(by)
    w = W.partitionBy(*by).orderBy(x)
    seg = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("__seg", seg).groupBy(*by).agg(F.coalesce(F.sum("__seg"), F.lit(0.0)).alias(out))


def guarded_slope(y: Column, x: Column) -> Column:
    """Least-squares slope as an aggregate; NULL without variance in x."""
    return F.when(F.max(x) > F.min(x), safe_div(F.covar_pop(y, x), F.var_pop(x)))


def tail_slope(df: DataFrame, by, x: str, y: str, start: float | None = None, min_points: int = 4,
               out: str = "tail_slope") -> DataFrame:
    """Slope from the peak (first maximum) or from a fixed start to the end of the profile."""
    by = _list(by)
    if start is None:
        w = W.partitionBy(*by)
        peak = F.max(F.struct(F.col(y), -F.col(x))).over(w)
        tail = df.withColumn("__x0", -peak["col2"]).where(F.col(x) >= F.col("__x0"))
    else:
        tail = df.withColumn("__x0", F.lit(float(start))).where(F.col(x) >= F.col("__x0"))
    n = F.count("*")
    return tail.groupBy(*by).agg(
        F.min("__x0").alias("tail_start"), n.alias("n_tail"),
        F.when(n >= min_points, guarded_slope(F.col(y), F.col(x))).alias(out))


def first_below(df: DataFrame, by, x: str, y: str, threshold: float, min_obs: int) -> DataFrame:
    """First bin below a threshold; right-censored at the last observed bin."""
    hit = F.min(F.when(F.col(y) < threshold, F.col(x)))
    return df.groupBy(*_list(by)).agg(
        hit.alias("first_below"), F.max(x).alias("last_seen"), F.count("*").alias("n_obs")
    ).where(F.col("n_obs") >= min_obs).withColumns({
        "censored": F.col("first_below").isNull(), "delay": F.coalesce("first_below", "last_seen")})


def ranked(df: DataFrame, order, by=(), out: str = "position") -> DataFrame:
    """Position along an order, inside bounded groups."""
    w = W.partitionBy(*(_list(by) or [F.lit(0)])).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w))


def interpolate(df: DataFrame, by, ts: str, value: str, step_minutes: int = 5, limit: int = 3) -> DataFrame:
    """Linear interpolation in time onto a regular grid, filling at most `limit` points after a reading.

    Readings and grid times are merged; a missing point is filled only if fewer
    than `limit` missing points lie between it and the last reading, and past
    the final reading the last value is held. A series is worked on one day at
    a time: each day carries the last reading before it and the first one after
    it, so a long series never sits in one task.
    """
    by = _list(by)
    per_day = 24 * 60 // step_minutes
    obs = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(ts).alias("ts")).agg(F.avg(value).alias("v"))
    obs = obs.withColumn("day", F.to_date("ts"))
    point = F.struct("ts", "v")
    held = obs.groupBy(*by, "day").agg(F.min_by(point, "ts").alias("first"), F.max_by(point, "ts").alias("last"))
    span = held.groupBy(*by).agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    days = span.select(*by, F.explode(F.sequence("d0", "d1")).alias("day")).join(held, [*by, "day"], "left")
    w = W.partitionBy(*by).orderBy("day")
    days = days.select(
        *by, "day",
        F.last("last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("prev"),
        F.last("first", ignorenulls=True).over(
            W.partitionBy(*by).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)).alias("next"))
    base = F.col("day").cast("timestamp_ntz")
    minutes = F.sequence(F.lit(0), F.lit(24 * 60 - step_minutes), F.lit(step_minutes))
    grid = days.withColumn("__m", F.explode(minutes)).select(
        *by, "day", F.timestamp_add("MINUTE", F.col("__m"), base).alias("ts"), F.lit(True).alias("__grid"))
    both = obs.join(grid, [*by, "day", "ts"], "full").join(days, [*by, "day"])
    w = W.partitionBy(*by, "day").orderBy("ts")
    back = w.rowsBetween(W.unboundedPreceding, 0)
    # looking ahead as looking back in reverse order: a running frame, linear in the rows
    ahead = W.partitionBy(*by, "day").orderBy(F.desc("ts")).rowsBetween(W.unboundedPreceding, 0)
    seen = F.when(F.col("v").isNotNull(), point)
    both = both.withColumns({
        "__a": F.coalesce(F.last(seen, ignorenulls=True).over(back), F.col("prev")),
        "__b": F.coalesce(F.last(seen, ignorenulls=True).over(ahead), F.col("next")),
        "__block": F.count("v").over(back)})
    prev_day = F.to_date("prev.ts")
    into_day = F.floor(tp.hours_since("prev.ts", prev_day.cast("timestamp_ntz")) * 60 / step_minutes)
    before = per_day - 1 - into_day + per_day * (F.datediff("day", prev_day) - 1)
    inside = F.row_number().over(W.partitionBy(*by, "day", "__block").orderBy("ts"))
    gap = F.when(F.col("__block") > 0, inside - 1).otherwise(before + inside)
    both = both.withColumn("__gap", gap)
    part = safe_div(tp.hours_since("ts", "__a.ts"), tp.hours_since("__b.ts", "__a.ts"))
    filled = (
        F.when(F.col("v").isNotNull(), F.col("v"))
        .when(F.col("__a").isNull() | (F.col("__gap") > limit), F.lit(None).cast("double"))
        .when(F.col("__b").isNull(), F.col("__a.v"))
        .otherwise(F.col("__a.v") + part * (F.col("__b.v") - F.col("__a.v"))))
    return both.withColumn("value", filled).where("__grid").select(*by, "ts", "value")
