"""Ranks, quantiles and top shares.

Two forms. `avg_rank` is a plain window for groups bounded by the calendar or
the station list. Everything else rests on `cumulative_counts`, which never
needs a whole group in one task: ties are folded first, values are cut into
ranges, ranges are scanned in parallel and tied together by their totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.functions.numeric import safe_div
from duskline.session import settled


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def avg_rank(col: str, by=()) -> Column:
    """Average-tie rank inside a bounded partition, as double."""
    part = _list(by) or [F.lit(0)]
    w = W.partitionBy(*part).orderBy(col)
    peers = F.count("*").over(w.rangeBetween(W.currentRow, W.currentRow))
    return F.rank().over(w).cast("double") + (peers.cast("double") - 1) / 2


def with_ranks(df: DataFrame, cols, by=(), prefix: str = "r_") -> DataFrame:
    """Listwise-complete average ranks of several columns inside bounded groups."""
    df = df.na.drop(subset=list(cols))
    return df.withColumns({f"{prefix}{c}": avg_rank(c, by) for c in cols})


def rank_z(df: DataFrame, cols, by=(), prefix: str = "z_") -> DataFrame:
    """Ranks standardised by their population SD inside the listwise-complete group."""
    by = _list(by)
    part = W.partitionBy(*(by or [F.lit(0)]))
    out = with_ranks(df, cols, by, "__r_")
    out = out.withColumns({
        f"{prefix}{c}": safe_div(F.col(f"__r_{c}") - F.avg(f"__r_{c}").over(part), F.stddev_pop(f"__r_{c}").over(part))
        for c in cols})
    return out.drop(*[f"__r_{c}" for c in cols])


def _count_below(cuts: str, n: int) -> Column:
    """How many of the n cut points lie below `value`; plain comparisons compile, a lambda would be interpreted."""
    if n > 64:
        return F.size(F.filter(cuts, lambda e: e < F.col("value")))
    below = F.lit(0)
    for i in range(n):
        below = below + F.coalesce(F.get(cuts, F.lit(i)) < F.col("value"), F.lit(False)).cast("int")
    return below


def cumulative_counts(df: DataFrame, by, col: str, pieces: int | None = None, weight: str | None = None) -> DataFrame:
    """Distinct values of each group with their count, the count below, and the group total.

    1. fold ties: (group, value) counts, combined map-side;
    2. cut each group's values at approximate quantiles (a mergeable sketch), so
       one group spreads over `pieces` tasks;
    3. running counts inside each (group, range);
    4. add the totals of the lower ranges, at most `pieces` rows per group.
    `pieces` follows the shuffle partitions: a task holds about 1/pieces of the distinct
    values of the largest group. A value shared by a third of all rows is one
    row after step 1. NULL values are left out. With `weight`, rows count that much.
    """
    by = _list(by)
    amount = F.count("*") if weight is None else F.sum(weight)
    freq = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(amount.alias("n"))
    pieces = pieces or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / pieces for i in range(1, pieces)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(col, probs, 1000).alias("__cuts"))
    cut = freq.join(cuts, by) if by else freq.withColumn("__cuts", cuts.scalar())
    cut = cut.withColumn("__piece", _count_below("__cuts", pieces - 1)).drop("__cuts")
    inside = W.partitionBy(*by, "__piece").orderBy("value")
    run = cut.withColumn("__below", F.sum("n").over(inside) - F.col("n"))
    sums = cut.groupBy(*by, "__piece").agg(F.sum("n").alias("__n"))
    pw = W.partitionBy(*(by or [F.lit(0)]))
    sums = sums.withColumns({
        "__before": F.sum("__n").over(pw.orderBy("__piece")) - F.col("__n"),
        "total": F.sum("__n").over(pw),
    }).drop("__n")
    out = run.join(sums, [*by, "__piece"])
    return out.select(*by, "value", "n", (F.col("__below") + F.col("__before")).alias("below"), "total")


def spread_rank(df: DataFrame, col: str, by=(), out: str = "rank", pieces: int | None = None) -> DataFrame:
    """Average-tie rank of groups of any size; NULL values get a NULL rank. Adds `out` and `out_n`."""
    by = _list(by)
    cc = cumulative_counts(df, by, col, pieces).select(
        *[F.col(b).alias(f"__{b}") for b in by], F.col("value").alias("__v"),
        (F.col("below").cast("double") + (F.col("n").cast("double") + 1) / 2).alias(out),
        F.col("total").alias(f"{out}_n"))
    cond = F.col(col) == F.col("__v")
    for b in by:
        cond = cond & (F.col(b) == F.col(f"__{b}"))
    return df.join(cc, cond, "left").drop("__v", *[f"__{b}" for b in by])


def pct_rank(df: DataFrame, col: str, by=(), out: str = "pct", reverse: bool = False, pieces: int | None = None) -> DataFrame:
    """Percentile rank: average rank over the non-null count; reversed is one minus that."""
    r = spread_rank(df, col, by, "__rk", pieces)
    p = F.col("__rk") / F.col("__rk_n").cast("double")
    return r.withColumn(out, 1.0 - p if reverse else p).drop("__rk", "__rk_n")


def exact_quantiles(df: DataFrame, by, col: str, ps, pieces: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles of groups of any size, one row per (group, p)."""
    by = _list(by)
    cc = cumulative_counts(df, by, col, pieces)
    long = cc.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    h = (F.col("total") - 1).cast("double") * F.col("p")
    lo, hi = F.floor(h), F.ceil(h)
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    long = long.withColumns({"__lo": F.when(holds(lo), F.col("value")), "__hi": F.when(holds(hi), F.col("value")),
                             "__f": h - lo.cast("double")})
    long = long.where(F.col("__lo").isNotNull() | F.col("__hi").isNotNull())
    return long.groupBy(*by, "p").agg(F.max("__lo").alias("a"), F.max("__hi").alias("b"), F.max("__f").alias("f")).select(
        *by, "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("quantile"))


def top_shares(df: DataFrame, score: str, shares, order: str, by=(), out: str = "selected", pieces: int | None = None) -> DataFrame:
    """Flag exactly ceil(share * n) rows per group for several shares: an array of booleans, one per share.

    Best score first, ties by `order`. All cut scores come from one
    `cumulative_counts`; only rows tied at a cut are ranked by `order`, the same
    way, so no group is ever sorted in one task. The cut table has one small
    row per group. The scored table is read several times, so it is settled
    first: pass only the columns needed.
    """
    by, shares = _list(by), [float(s) for s in shares]
    neg = settled(df.withColumn("__neg", -F.col(score)))
    ks = F.array(*[F.struct(F.lit(i).alias("i"), F.ceil(F.round(F.lit(s) * F.col("total"), 9)).alias("k")) for i, s in enumerate(shares)])
    cc = cumulative_counts(neg, by, "__neg", pieces).select("*", F.inline(ks))
    cut = cc.where((F.col("below") < F.col("k")) & (F.col("k") <= F.col("below") + F.col("n")))
    cuts = settled(cut.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(
        "i", F.col("value").alias("cut"), (F.col("k") - F.col("below")).alias("need"), F.col("n").alias("tied")))).alias("__c")))

    def attach(d: DataFrame, small: DataFrame, name: str) -> DataFrame:
        return d.join(small, by, "left") if by else d.withColumn(name, small.select(name).scalar())

    flagged = attach(neg, cuts, "__c")
    open_ties = F.filter("__c", lambda c: (F.col("__neg") == c["cut"]) & (c["need"] < c["tied"]))
    tied = flagged.where(F.size(open_ties) > 0).select(*by, order, F.inline(open_ties))
    last = cumulative_counts(tied, [*by, "i", "need"], order, pieces).where(F.col("below") + 1 == F.col("need"))
    lasts = last.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("__l"))
    flagged = attach(flagged, lasts, "__l")

    def chosen(c: Column) -> Column:
        stop = F.try_element_at("__l", c["i"])
        return (F.col("__neg") < c["cut"]) | ((F.col("__neg") == c["cut"]) & (stop.isNull() | (F.col(order) <= stop)))

    return flagged.withColumn(out, F.transform("__c", lambda c: F.coalesce(chosen(c), F.lit(False)))).drop("__neg", "__c", "__l")


def top_share(df: DataFrame, score: str, share: float, order: str, by=(), out: str = "selected", pieces: int | None = None) -> DataFrame:
    """`top_shares` for one share: a boolean column."""
    f = top_shares(df, score, [share], order, by, "__sel", pieces)
    return f.withColumn(out, F.get("__sel", F.lit(0))).drop("__sel")


def by_share(df: DataFrame, shares, *flags: str) -> DataFrame:
    """One row per share from array flags of `top_shares`."""
    arr = F.array(*[F.lit(float(s)) for s in shares])
    rest = [c for c in df.columns if c not in flags]
    return df.select(*rest, F.inline(F.arrays_zip(arr.alias("share"), *[F.col(f) for f in flags])))


# Tier names from the lowest to the highest, and their quantiles.
TIERS = ("baseline_monitoring", "elevated_monitoring", "high_priority", "highest_priority")
TIER_QUANTILES = (0.50, 0.75, 0.90)


def tiers(df: DataFrame, score: str, by=(), out: str = "tier", pieces: int | None = None, digits: int = 9) -> DataFrame:
    """Quantile tiers; unlike `top_share`, rows tied with a threshold all rise into the tier."""
    by = _list(by)
    q = exact_quantiles(df, by, score, TIER_QUANTILES, pieces)
    wide = q.groupBy(*by).pivot("p", list(TIER_QUANTILES)).agg(F.first("quantile"))
    cols = {f"__q{i}": F.round(F.col(f"`{p}`"), digits) for i, p in enumerate(TIER_QUANTILES)}
    wide = wide.select(*by, *[e.alias(n) for n, e in cols.items()])
    if by:
        base, th = df.join(wide, by), {n: F.col(n) for n in cols}
    else:
        st = wide.select(F.struct(*cols).alias("s")).scalar()
        base, th = df, {n: st[n] for n in cols}
    v = F.round(F.col(score), digits)
    lab = (F.when(v >= th["__q2"], TIERS[3]).when(v >= th["__q1"], TIERS[2]).when(v >= th["__q0"], TIERS[1]).otherwise(TIERS[0]))
    return base.withColumn(out, lab).drop(*cols)


def qcut(df: DataFrame, col: str, q: int, by=(), out: str = "bin", pieces: int | None = None, digits: int = 9) -> DataFrame:
    """Equal-frequency bins 0..q-1 from interpolated quantile edges; bins are closed on the right."""
    by = _list(by)
    edges = exact_quantiles(df, by, col, [i / q for i in range(1, q)], pieces)
    edges = edges.groupBy(*by).agg(F.sort_array(F.collect_list(F.round("quantile", digits))).alias("__e"))
    v = F.round(F.col(col), digits)
    base = df.join(edges, by) if by else df.withColumn("__e", edges.scalar())
    bin_ = F.size(F.filter(F.col("__e"), lambda e: e < v))
    return base.withColumn(out, F.when(v.isNotNull(), bin_)).drop("__e")
