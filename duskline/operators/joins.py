"""Joins and set operations.

No broadcast hints: adaptive execution broadcasts a side once its measured
size is under the threshold, and sort-merges (splitting skewed keys) above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.functions import timeparts as tp


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def factor_levels(df: DataFrame, **factors) -> DataFrame:
    """Every row once per combination of the given factor levels, as rows with level columns."""
    for name, levels in factors.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    return df


def paired_series(df: DataFrame, key: str, a, b, on: str, value: str) -> DataFrame:
    """Two series of one table side by side. One conditional aggregate instead of a self-join."""
    k = F.col(key)
    return (
        df.where(k.isin(a, b))
        .groupBy(on)
        .agg(F.max(F.when(k == a, F.col(value))).alias("first"), F.max(F.when(k == b, F.col(value))).alias("second"))
        .where(F.col("first").isNotNull() & F.col("second").isNotNull())
    )


def range_join(left: DataFrame, right: DataFrame, on, hours: Column, lo: float, hi: float, out: str = "hours") -> DataFrame:
    """Equi join on a date key with an hour band around an event."""
    return left.join(right, on).withColumn(out, hours).where(F.col(out).between(lo, hi))


def matched_hours(fine: DataFrame, ts: str, value: str, coarse: DataFrame, hour: str, n: int = 4, by=()) -> DataFrame:
    """Complete fine-grained hours (exactly n readings) against an hourly reference."""
    by = list(by)
    hourly = (
        fine.groupBy(*by, tp.ceil_hour(ts).alias(hour))
        .agg(F.avg(value).alias("fine_mean"), F.count("*").alias("n"))
        .where(F.col("n") == n)
    )
    return hourly.join(coarse, [*by, hour])


def null_where_key_in(df: DataFrame, col: str, keys: DataFrame, on: str) -> DataFrame:
    """Set a column to NULL on flagged keys."""
    flagged = keys.select(on).distinct().withColumn("__flag", F.lit(True))
    return df.join(flagged, on, "left").withColumn(
        col, F.when(F.col("__flag").isNull(), F.col(col))).drop("__flag")


def jaccard(df: DataFrame, a: Column, b: Column, by=()) -> DataFrame:
    """Sizes, overlap, union and Jaccard index of two boolean selections."""
    agg = [
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"),
        F.count_if(a & b).alias("n_both"), F.count_if(a | b).alias("n_either"),
    ]
    out = df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
    n = F.col("n_either")
    return out.withColumn("jaccard", F.col("n_both") / F.when(n > 0, n.cast("double")))


def membership(a: Column, b: Column) -> Column:
    """Three-way category of two selections (NULL counts as outside)."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return F.when(a & b, "both").when(a, "first_only").when(b, "second_only").otherwise("neither")


def lag_pairs(df: DataFrame, order, cols, max_lag: int, by=()) -> DataFrame:
    """Row pairs at most max_lag rows apart, in row order, as one row per (row, lag).

    Lags come from one window over the ordered series, so the work is
    n * max_lag; series here are bounded by the calendar.
    """
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(*order)
    lags = F.array(*[
        F.struct(F.lit(l).alias("lag"), *[F.lag(c, l).over(w).alias(f"{c}_lag") for c in cols],
                 F.lag(F.lit(True), l).over(w).alias("__ok"))
        for l in range(max_lag + 1)
    ])
    row = df.withColumn("position", F.row_number().over(w)).withColumn("__l", lags)
    return row.select("*", F.inline("__l")).where("__ok").drop("__l", "__ok")
