"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskline.functions.numeric import safe_div


def scoped(df: DataFrame, scopes, aggs: dict[str, Column]) -> DataFrame:
    """The same summary over several scopes in one output (grouping sets).

    scopes: column names; the overall row has scope 'all'. One pass expands the
    rows per scope and combines them map-side.
    """
    scopes = list(scopes)
    tagged = df.withColumn("__s", F.explode(F.array(
        F.struct(F.lit("all").alias("scope"), F.lit("all").alias("level")),
        *[F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("level")) for s in scopes],
    )))
    return tagged.groupBy(F.col("__s.scope").alias("scope"), F.col("__s.level").alias("level")).agg(
        *[e.alias(n) for n, e in aggs.items()])


def pivot_fill(df: DataFrame, index, col: str, values, agg: Column, prefix: str = "", fill=0) -> DataFrame:
    """Pivot with declared values (fixed order, no discovery pass) and a fill value."""
    index = [index] if isinstance(index, str) else list(index)
    out = df.groupBy(*index).pivot(col, list(values)).agg(agg)
    out = out.select(*index, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])
    return out if fill is None else out.na.fill(fill, [f"{prefix}{v}" for v in values])


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def by_factor(df: DataFrame, factors, est: str) -> DataFrame:
    """Median, min, max and size of an estimate per level of every factor, stacked."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
    long = df.where(F.col(est).isNotNull()).select(est, F.inline(pairs))
    return long.groupBy("factor", "level").agg(
        F.percentile(est, F.lit(0.5)).alias("median"), F.min(est).alias("min"), F.max(est).alias("max"),
        F.count("*").alias("size"))


def arg_row(df: DataFrame, by, col: str, tie, cols, largest: bool = True) -> DataFrame:
    """Row of the largest (smallest) value per group; ties go to the smallest tie key."""
    by = [by] if isinstance(by, str) else list(by)
    value = -F.col(col) if largest else F.col(col)
    pick = F.min_by(F.struct(*cols), F.struct(value, F.col(tie)))
    out = df.where(F.col(col).isNotNull()).groupBy(*by).agg(pick.alias("__r"))
    return out.select(*by, *[F.col(f"__r.{c}").alias(c) for c in cols])


def edge_values(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """First and last value along x."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(
        F.min(x).alias("first_x"), F.min_by(y, x).alias("first_y"), F.max(x).alias("last_x"), F.max_by(y, x).alias("last_y"))


def variance_identity(df: DataFrame, by, a: str, b: str) -> DataFrame:
    """Var(a-b) = Var a + Var b - 2 Cov on rows where both are present."""
    by = [by] if isinstance(by, str) else list(by)
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"),
        F.var_samp(F.col(a) - F.col(b)).alias("var_diff"),
        F.covar_samp(a, b).alias("cov_ab"),
    ).withColumn("identity", F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab"))


def guarded_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson r of rows where both are present; NULL (not an error) without variance."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    x2, y2 = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.when((F.max(x2) > F.min(x2)) & (F.max(y2) > F.min(y2)),
                  safe_div(F.covar_pop(x2, y2), F.stddev_pop(x2) * F.stddev_pop(y2)))


def paired_summary(df: DataFrame, a: str, b: str, by=(), tol: float = 0.3) -> DataFrame:
    """Bias, spread, errors, quantiles and correlation of paired values.

    Quantiles keep the distinct differences of the group: use it on panels, and
    `ranks.exact_quantiles` for unbounded groups.
    """
    d = F.col(a) - F.col(b)
    q = F.percentile(d, F.array(*[F.lit(p) for p in (0.025, 0.5, 0.975)]))
    aggs = {
        "n": F.count(d), "bias": F.avg(d), "median_diff": F.get(q, F.lit(1)), "sd_diff": F.stddev_samp(d),
        "mae": F.avg(F.abs(d)), "rmse": F.sqrt(F.avg(d * d)), "q025": F.get(q, F.lit(0)), "q975": F.get(q, F.lit(2)),
        "min_diff": F.min(d), "max_diff": F.max(d), "share_within": F.avg((F.abs(d) <= tol).cast("double")),
        "pearson_r": guarded_corr(a, b),
    }
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(*[e.alias(n) for n, e in aggs.items()])


def histogram(df: DataFrame, col: str, edges, by=()) -> DataFrame:
    """Counts per bin of explicit edges; bins are closed left, the last one on both sides."""
    edges = [float(e) for e in edges]
    v, last = F.col(col), len(edges) - 2
    b = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        upper = (v <= edges[i + 1]) if i == last else (v < edges[i + 1])
        b = F.when((v >= edges[i]) & upper, F.lit(i)).otherwise(b)
    lo = F.get(F.array(*[F.lit(e) for e in edges]), F.col("bin"))
    hi = F.get(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    return (df.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n"))
            .withColumns({"lo": lo, "hi": hi}))


def sign_consistency(df: DataFrame, by, est: str, group: str) -> DataFrame:
    """Share of the majority sign, spread of the estimates, and range of the medians over `group`."""
    by = [by] if isinstance(by, str) else list(by)
    df = df.where(F.col(est).isNotNull())
    e = F.col(est)
    q = F.percentile(e, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    main = df.groupBy(*by).agg(
        F.get(q, F.lit(1)).alias("median_est"), F.min(e).alias("min_est"), F.max(e).alias("max_est"),
        (F.get(q, F.lit(2)) - F.get(q, F.lit(0))).alias("iqr"),
        F.greatest(F.avg((e > 0).cast("double")), F.avg((e < 0).cast("double"))).alias("sign_consistency"),
        F.count("*").alias("n_specs"))
    med = df.groupBy(*by, group).agg(F.percentile(e, F.lit(0.5)).alias("__m"))
    rng = med.groupBy(*by).agg((F.max("__m") - F.min("__m")).alias("median_range"))
    return main.join(rng, by)
