"""Rank association with dependence-aware tests.

Groups here are sets of nights (a specification, a sample, a replicate), so
rank windows stay bounded by the calendar. Raw readings never reach these
operators: they are folded to nights first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.functions.numeric import safe_div
from duskline.operators.aggregates import guarded_corr
from duskline.operators.ranks import avg_rank, cumulative_counts
from duskline.session import settled


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _part(by) -> W:
    return W.partitionBy(*(_list(by) or [F.lit(0)]))


def pearson(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Pearson r over pairwise-complete rows; NULL without variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*_list(by)).agg(guarded_corr(x, y).alias("r"), F.count("*").alias("n"))


def spearman(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Spearman rho; ranks are taken on the pairwise-complete rows of each group."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = both.select(*_list(by), avg_rank(x, by).alias("__x"), avg_rank(y, by).alias("__y"))
    return r.groupBy(*_list(by)).agg(guarded_corr("__x", "__y").alias("rho"), F.count("*").alias("n"))


def spearman_p(rho, n) -> tuple[Column, Column]:
    """t statistic and degrees of freedom of a rank correlation, for `student_two_sided_p`."""
    rho = F.col(rho) if isinstance(rho, str) else rho
    df = (F.col(n) if isinstance(n, str) else n).cast("double") - 2
    return rho * F.sqrt(safe_div(df, (1 - rho) * (1 + rho))), df


def corr_matrix(df: DataFrame, cols, method: str = "spearman", by=()) -> DataFrame:
    """Long correlation matrix (each unordered pair once), pairwise complete."""
    by = _list(by)
    pairs = [(a, b) for i, a in enumerate(cols) for b in list(cols)[i + 1:]]
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in pairs])))
    out = (spearman if method == "spearman" else pearson)(long, "x", "y", [*by, "a", "b"])
    return out.withColumnRenamed("rho", "r")


def corr_matrix_any_size(df: DataFrame, cols, pieces: int | None = None) -> DataFrame:
    """Spearman matrix of a table too large for rank windows (no missing values): ranks by ranges, one sum pass."""
    from duskline.operators.ranks import spread_rank

    for c in cols:
        df = spread_rank(df, c, (), f"__r_{c}", pieces)
    pairs = [(a, b) for i, a in enumerate(cols) for b in list(cols)[i + 1:]]
    row = df.agg(*[guarded_corr(f"__r_{a}", f"__r_{b}").alias(f"{a}|{b}") for a, b in pairs], F.count("*").alias("n"))
    long = row.select("n", F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])))
    return long.select("a", "b", "r", "n")


def _active(use, cov: str) -> Column:
    return use[cov] if use and cov in use else F.lit(True)


def _complete_rows(df: DataFrame, x: str, y: str, covs, use) -> DataFrame:
    keep = F.col(x).isNotNull() & F.col(y).isNotNull()
    for c in covs:
        keep = keep & (~_active(use, c) | F.col(c).isNotNull())
    return df.where(keep)


def partial_spearman(
    df: DataFrame, x: str, y: str, covs=(), by=(), min_n: int = 3, use: dict[str, Column] | None = None, raw=()
) -> DataFrame:
    """Partial rank correlation of x and y given covariates, for every group in one job.

    Rows are dropped listwise before ranking. `use` gives, per covariate, a
    boolean column saying whether the row's group conditions on it, so groups
    with different covariate sets share a pass. Covariates in `raw` enter
    unranked. Covariates are swept one after another from the matrix of
    covariances, which equals correlating least-squares residuals.
    """
    by, covs = _list(by), list(covs)
    rows = _complete_rows(df, x, y, covs, use)
    val = {"v0": avg_rank(x, by), "v1": avg_rank(y, by)}
    for i, c in enumerate(covs):
        v = F.col(c).cast("double") if c in raw else avg_rank(c, by)
        val[f"v{i + 2}"] = F.when(_active(use, c), v).otherwise(F.lit(0.0))
    rows = rows.select(*by, *[e.alias(n) for n, e in val.items()])
    names = list(val)
    k = len(names)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    m = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in upper]).alias("__u"))
    at = {p: q for q, p in enumerate(upper)}
    full = F.array(*[F.get("__u", F.lit(at[min(i, j), max(i, j)])) for i in range(k) for j in range(k)])
    m = m.withColumn("__m", full)

    def sweep(acc: Column, z: Column) -> Column:
        pivot = F.get(acc, z * k + z)
        usable = pivot > 1e-10 * F.get("__m", z * k + z)
        return F.when(usable, F.transform(acc, lambda v, i: v - F.get(acc, F.floor(i / k).cast("int") * k + z)
                                          * F.get(acc, z * k + i % k) / pivot)).otherwise(acc)

    swept = F.aggregate(F.sequence(F.lit(2), F.lit(k - 1)), F.col("__m"), sweep) if covs else F.col("__m")
    m = m.withColumn("__s", swept)
    ok = (F.col("n") >= min_n) & (F.get("__s", F.lit(0)) > 1e-10 * F.get("__m", F.lit(0))) & (
        F.get("__s", F.lit(k + 1)) > 1e-10 * F.get("__m", F.lit(k + 1)))
    r = F.get("__s", F.lit(1)) / F.sqrt(F.get("__s", F.lit(0)) * F.get("__s", F.lit(k + 1)))
    return m.select(*by, F.when(ok, r).alias("rho"), "n")


def rank_residuals(df: DataFrame, x: str, y: str, covs=(), by=(), use=None, keep=()) -> DataFrame:
    """Rank x and y, remove the covariate ranks by least squares, keep the residuals as rx and ry.

    Sequential orthogonalisation inside the group: each covariate is removed
    from x, y and the later covariates. All steps share one partitioning.
    """
    by, covs = _list(by), list(covs)
    rows = _complete_rows(df, x, y, covs, use)
    w = _part(by)
    rows = rows.withColumns({"rx": avg_rank(x, by), "ry": avg_rank(y, by), **{
        f"__c{i}": F.when(_active(use, c), avg_rank(c, by)).otherwise(F.lit(0.0)) for i, c in enumerate(covs)}})
    for i in range(len(covs)):
        z = f"__c{i}"
        rows = rows.withColumns({"__m": F.avg(z).over(w), "__v": F.var_pop(z).over(w)})
        d = F.col(z) - F.col("__m")
        slope = lambda c: F.coalesce(safe_div(F.covar_pop(c, z).over(w), F.when(F.col("__v") > 1e-9, F.col("__v"))), F.lit(0.0))
        rest = ["rx", "ry"] + [f"__c{j}" for j in range(i + 1, len(covs))]
        rows = rows.withColumns({f"__b_{c}": slope(c) for c in rest})
        rows = rows.withColumns({c: F.col(c) - F.col(f"__b_{c}") * d for c in rest})
    return rows.select(*by, *keep, "rx", "ry")


def _rotations(df: DataFrame, x: str, y: str, order: str, by) -> DataFrame:
    """Per group, the sums of x times y for every cyclic rotation of y, plus counts and sums."""
    s = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, x, y))).alias("__s"), F.min(order).alias("first"))
    s = s.withColumn("n", F.size("__s"))
    s = s.withColumns({"__x": F.transform("__s", lambda r: r[x]), "__y": F.transform("__s", lambda r: r[y])})
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
    turned = lambda k: F.concat(F.slice("__y", F.col("n") - k + 1, k), F.slice("__y", 1, F.col("n") - k))
    dots = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                       lambda k: total(F.zip_with("__x", turned(k), lambda p, q: p * q)))
    return s.select(*by, "n", "first", dots.alias("dots"), total(F.col("__x")).alias("sx"), total(F.col("__y")).alias("sy"),
                    total(F.transform("__x", lambda v: v * v)).alias("sxx"), total(F.transform("__y", lambda v: v * v)).alias("syy"))


def shift_p(df: DataFrame, x: str, y: str, order: str, by=()) -> DataFrame:
    """Exact circular-shift p of one series per group: share of rotations at least as extreme."""
    by = _list(by)
    r = _rotations(df, x, y, order, by)
    n = F.col("n").cast("double")
    denom = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n))
    null = F.transform("dots", lambda d: F.abs(d - F.col("sx") * F.col("sy") / n) / F.when(denom > 0, denom))
    hits = F.size(F.filter(null, lambda v: v >= F.get(null, F.lit(0)) - 1e-9))
    return r.select(*by, F.when(denom > 0, hits / n).otherwise(F.lit(1.0)).alias("p_shift"), F.col("n").alias("n_rotations"))


def stratified_shift_p(
    df: DataFrame, x: str, y: str, order: str, group: str, by=(), pieces: int | None = None
) -> DataFrame:
    """Exact shift p with every stratum rotated on its own.

    The strata are split into two halves; each half's distribution of sums is
    built by adding one stratum at a time and folding equal sums, and the tail
    is counted by ranking the thresholds of one half within the other. The
    full set of combinations is never formed.
    """
    by = _list(by)
    r = _rotations(df, x, y, order, [*by, group])
    r = r.withColumns({"pos": F.row_number().over(_part(by).orderBy("first")), "g": F.count("*").over(_part(by))})
    nn = F.sum("n").cast("double")
    centre = F.sum("sx") * F.sum("sy") / nn
    test = r.groupBy(*by).agg(
        nn.cast("long").alias("n"), F.first("g").alias("g"), centre.alias("k"), F.sum(F.get("dots", F.lit(0))).alias("__obs"),
        F.sqrt(F.greatest(F.lit(0.0), (F.sum("sxx") - F.sum("sx") * F.sum("sx") / nn)
                          * (F.sum("syy") - F.sum("sy") * F.sum("sy") / nn))).alias("denom"),
        F.product(F.col("n").cast("double")).alias("n_randomizations"))
    test = test.withColumn("cut", F.greatest(F.lit(0.0), F.abs(F.col("__obs") - F.col("k")) - 1e-12 * F.col("denom")))
    parts = r.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "dots"))).alias("__p"), F.first("g").alias("g"))
    most = parts.agg(F.max("g")).first()[0] or 0

    def half(left: bool) -> DataFrame:
        split = F.floor(F.col("g") / 2).cast("int")
        arrays = F.slice("__p", 1, split) if left else F.slice("__p", split + 1, F.col("g") - split)
        d = parts.select(*by, F.transform(arrays, lambda s: s["dots"]).alias("__a"), F.lit(0.0).alias("v"), F.lit(1).cast("long").alias("c"))
        steps = most // 2 if left else most - most // 2
        for i in range(steps):
            # a group with fewer strata adds a single zero at the missing steps
            add = F.coalesce(F.get("__a", F.lit(i)), F.array(F.lit(0.0)))
            d = d.withColumn("__d", F.explode(add)).withColumn("v", F.col("v") + F.col("__d")).drop("__d")
            if i:
                d = d.groupBy(*by, "v").agg(F.first("__a").alias("__a"), F.sum("c").alias("c"))
        return d.select(*by, "v", "c")

    left, right = half(True), half(False)
    keyed = lambda d: d if by else d.withColumn("__one", F.lit(0))
    keys = by or ["__one"]
    lt = keyed(left).join(keyed(test).select(*keys, "k", "cut"), keys).where(F.col("cut") > 0)
    lo, hi = F.col("k") - F.col("cut") - F.col("v"), F.col("k") + F.col("cut") - F.col("v")
    points = lt.select(*keys, "c", F.inline(F.array(
        F.struct(lo.alias("value"), F.lit(True).alias("low")), F.struct(hi.alias("value"), F.lit(False).alias("low")))))
    # read twice below (cut points and counts), so written once
    axis = settled(keyed(right).select(*keys, F.col("v").alias("value"), F.col("c").alias("w")).unionByName(
        points.select(*keys, "value", F.lit(0).cast("long").alias("w"))))
    cc = cumulative_counts(axis, keys, "value", pieces, weight="w")
    tail = points.join(cc, [*keys, "value"]).groupBy(*keys).agg(F.sum(
        F.col("c") * F.when(F.col("low"), F.col("below") + F.col("n")).otherwise(F.col("total") - F.col("below"))).alias("extreme"))
    out = keyed(test).join(tail, keys, "left")
    p = F.when(F.col("cut") > 0, F.col("extreme") / F.col("n_randomizations")).otherwise(F.lit(1.0))
    return out.select(*by, p.alias("p_shift"), "n", "n_randomizations")


def bh_adjust(df: DataFrame, p: str, by=(), out: str = "p_bh") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values of a (small) family per group; NULL p stays NULL."""
    keep = F.col(p).isNotNull()
    part = [*(_list(by) or [F.lit(0)]), keep]
    n = F.count("*").over(W.partitionBy(*part)).cast("double")
    k = F.row_number().over(W.partitionBy(*part).orderBy(p)).cast("double")
    raw = df.withColumns({"__raw": F.col(p) * n / k, "__k": k})
    running = F.min("__raw").over(
        W.partitionBy(*part).orderBy(F.desc("__k")).rowsBetween(W.unboundedPreceding, 0))
    return raw.withColumn(out, F.when(keep, F.least(F.lit(1.0), running))).drop("__raw", "__k")


def mann_whitney(df: DataFrame, x: str, group: str, a, b, by=()) -> DataFrame:
    """Two-sided Mann-Whitney U of two groups: tie-corrected normal approximation with continuity correction."""
    from duskline.functions.numeric import normal_two_sided_p

    by = _list(by)
    rows = df.where(F.col(group).isin(a, b) & F.col(x).isNotNull())
    ties = F.count("*").over(W.partitionBy(*(by or [F.lit(0)]), x)).cast("double")
    r = rows.withColumns({"__r": avg_rank(x, by), "__t": ties})
    n1, n2 = F.count_if(F.col(group) == a).cast("double"), F.count_if(F.col(group) == b).cast("double")
    s = r.groupBy(*by).agg(n1.alias("n1"), n2.alias("n2"), F.sum(F.when(F.col(group) == a, F.col("__r"))).alias("r1"),
                           F.sum(F.col("__t") * F.col("__t") - 1).alias("tie"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("tie") / (n * (n - 1)))
    z = safe_div(F.greatest(u, F.col("n1") * F.col("n2") - u) - F.col("n1") * F.col("n2") / 2 - 0.5, F.sqrt(var))
    return s.select(*by, u.alias("u"), "n1", "n2", z.alias("z"), F.least(F.lit(1.0), normal_two_sided_p(z)).alias("p"))


def verdict(est, ref, p, predicted) -> Column:
    """Outcome of a directional hypothesis, or of a declared null."""
    e, r, pv, pr = (F.col(c) if isinstance(c, str) else c for c in (est, ref, p, predicted))
    null = F.when(pv >= 0.05, "null_kept").otherwise("null_rejected")
    held = F.signum(e) == F.signum(r)
    return (F.when(pr == "null", null).when(held & (pv < 0.05), "held_significant")
            .when(held, "held").otherwise("reversed"))


def spec_rows(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Every row once per specification that admits it, with the specification's columns.

    A spec is {column: literal or Column}; its optional 'where' (a Column)
    selects rows. Specifications become rows with an id, and one grouped job
    estimates all of them.
    """
    fields = [k for k in specs[0] if k != "where"]
    items = [F.when(s.get("where", F.lit(True)), F.struct(*[
        (s[k] if isinstance(s[k], Column) else F.lit(s[k])).alias(k) for k in fields])) for s in specs]
    return df.withColumn("__spec", F.explode(F.array_compact(F.array(*items)))).select("*", "__spec.*").drop("__spec")


def union_specs(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
