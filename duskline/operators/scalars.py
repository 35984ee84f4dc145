"""Statistics of a whole (or training) table attached to every row.

One-row aggregates travel as scalar subqueries: no join, no cross product, and
the value is inlined once it is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.functions.numeric import safe_div


def scalar_struct(df: DataFrame, **exprs: Column) -> Column:
    """Struct of aggregates of df, usable as a column of any other DataFrame."""
    agg = df.agg(*[e.alias(n) for n, e in exprs.items()])
    return agg.select(F.struct(*exprs).alias("s")).scalar()


def zscore_train(df: DataFrame, cols, train: Column, prefix: str = "z_") -> DataFrame:
    """Standardise by the mean and sample SD of the rows where train holds."""
    st = scalar_struct(
        df.where(train),
        **{f"m_{c}": F.avg(c) for c in cols},
        **{f"s_{c}": F.stddev_samp(c) for c in cols},
    )
    return df.withColumns({f"{prefix}{c}": safe_div(F.col(c) - st[f"m_{c}"], st[f"s_{c}"]) for c in cols})


def zscore(df: DataFrame, cols, ddof: int = 1, by=(), prefix: str = "z_") -> DataFrame:
    """Whole-sample (or per-group) z-scores with ddof 1 or 0."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    by = [by] if isinstance(by, str) else list(by)
    if not by:
        st = scalar_struct(df, **{f"m_{c}": F.avg(c) for c in cols}, **{f"s_{c}": sd(c) for c in cols})
        return df.withColumns({f"{prefix}{c}": safe_div(F.col(c) - st[f"m_{c}"], st[f"s_{c}"]) for c in cols})
    st = df.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[sd(c).alias(f"__s_{c}") for c in cols])
    out = df.join(st, by, "left")
    out = out.withColumns({f"{prefix}{c}": safe_div(F.col(c) - F.col(f"__m_{c}"), f"__s_{c}") for c in cols})
    return out.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])


def label_by_quantiles(
    df: DataFrame, col: str, qs, train: Column, labels, out: str, by=(), digits: int = 9
) -> DataFrame:
    """Label rows by quantiles learnt where train holds.

    labels runs from low to high and has one entry more than qs; at or above
    the last threshold is the highest label, at or below the first the lowest,
    NULL falls into the middle one. Values and thresholds meet at `digits`
    decimals, so a threshold equal to a value always includes it.
    The quantile aggregate holds the distinct values of its group: use it on
    panels bounded by the calendar, and `ranks.exact_quantiles` otherwise.
    """
    lo_q, hi_q = qs
    lo_lab, mid_lab, hi_lab = labels
    by = [by] if isinstance(by, str) else list(by)
    q = F.percentile(F.col(col), F.array(F.lit(float(lo_q)), F.lit(float(hi_q))))
    v = F.round(F.col(col), digits)
    if by:
        th = df.where(train).groupBy(*by).agg(q.alias("__q"))
        base = df.join(th, by, "left")
        lo, hi = F.round(F.get("__q", F.lit(0)), digits), F.round(F.get("__q", F.lit(1)), digits)
    else:
        st = scalar_struct(df.where(train), q=q)
        base = df
        lo, hi = F.round(F.get(st["q"], F.lit(0)), digits), F.round(F.get(st["q"], F.lit(1)), digits)
    label = F.when(v >= hi, F.lit(hi_lab)).when(v <= lo, F.lit(lo_lab)).otherwise(F.lit(mid_lab))
    return base.withColumn(out, label).drop("__q")


def anomaly(df: DataFrame, by, col: str, out: str = "anomaly") -> DataFrame:
    """Deviation from the group mean.

    The mean comes from a grouped aggregate joined back, so a hot group is
    combined map-side and its rows stay spread; a window would sort it in one task.
    """
    by = [by] if isinstance(by, str) else list(by)
    means = df.groupBy(*by).agg(F.avg(col).alias("__mean"))
    return df.join(means, by).withColumn(out, F.col(col) - F.col("__mean")).drop("__mean")


def one_hot(df: DataFrame, col: str, levels, drop_first: bool = True) -> DataFrame:
    """0/1 columns for the given levels, the first one dropped as the base."""
    use = list(levels)[1:] if drop_first else list(levels)
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("double"), F.lit(0.0)) for v in use})


def row_stats(cols) -> dict[str, Column]:
    """Mean, sample SD, max, min and range across columns of a row, skipping NULL."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda v: v.isNotNull())
    n = F.size(arr)
    mean = safe_div(F.aggregate(arr, F.lit(0.0), lambda a, v: a + v), n)
    ss = F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return {
        "row_mean": mean,
        "row_sd": F.sqrt(safe_div(ss, F.when(n > 1, n - 1))),
        "row_max": F.array_max(arr),
        "row_min": F.array_min(arr),
        "row_range": F.array_max(arr) - F.array_min(arr),
    }


__all__ = ["W", "anomaly", "label_by_quantiles", "one_hot", "row_stats", "scalar_struct", "zscore", "zscore_train"]
