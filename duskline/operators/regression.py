"""Least squares from grouped moments.

Spark reduces each group to means and covariances (one row per group); the
k-by-k solves run on batches of those rows inside tasks. Nothing is fitted on
the driver, and no group's rows are gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.functions.numeric import normal_two_sided_p, safe_div, student_two_sided_p
from duskline.session import settled


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def moments(cols, weight: Column | None = None) -> list[Column]:
    """Aggregates n, means and covariances (upper triangle) of the columns."""
    c = [F.col(x) for x in cols]
    cov = [F.covar_pop(c[i], c[j]) for i in range(len(c)) for j in range(i, len(c))]
    return [F.count("*").cast("double").alias("n"), F.array(*[F.avg(x) for x in c]).alias("means"), F.array(*cov).alias("cov")]


def shifted_moments(df: DataFrame, cols, by) -> DataFrame:
    """`moments` for many columns: plain sums of products around the table's own means.

    A sum needs one buffer where a covariance needs four; shifting by the
    overall means keeps the subtraction of squares harmless.
    """
    k = len(cols)
    st = df.agg(F.array(*[F.avg(c) for c in cols]).alias("m")).scalar()
    d = df.withColumn("__m", st)
    d = d.select(*by, "__m", *[(F.col(c) - F.get("__m", F.lit(i))).alias(f"__d{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    g = d.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), F.first("__m").alias("__m"), *[F.avg(f"__d{i}").alias(f"__a{i}") for i in range(k)],
        *[F.avg(F.col(f"__d{i}") * F.col(f"__d{j}")).alias(f"__p{i}_{j}") for i, j in pairs])
    return g.select(*by, "n", F.array(*[F.col(f"__a{i}") + F.get("__m", F.lit(i)) for i in range(k)]).alias("means"),
                    F.array(*[F.col(f"__p{i}_{j}") - F.col(f"__a{i}") * F.col(f"__a{j}") for i, j in pairs]).alias("cov"))


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(flat), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def _pinv(a: np.ndarray) -> np.ndarray:
    """Symmetric pseudo-inverse per batch row, on the correlation scale."""
    d = np.sqrt(np.maximum(np.einsum("bii->bi", a), 0))
    s = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0)
    return np.linalg.pinv(a * s[:, :, None] * s[:, None, :], rcond=1e-10, hermitian=True) * s[:, :, None] * s[:, None, :]


_VECTOR = T.ArrayType(T.DoubleType())
FIT = T.StructType([
    T.StructField("beta", _VECTOR), T.StructField("se", _VECTOR), T.StructField("r2", T.DoubleType()),
    T.StructField("sigma", T.DoubleType()), T.StructField("rss", T.DoubleType())])


@F.pandas_udf(FIT)
def _fit(n: pd.Series, means: pd.Series, cov: pd.Series) -> pd.DataFrame:
    """Intercept and slopes of the last column on the others, with classical standard errors."""
    nv, m = n.to_numpy(float), np.vstack(means.to_numpy()).astype(float)
    k = m.shape[1]
    s = _square(np.vstack(cov.to_numpy()).astype(float), k)
    inv = _pinv(s[:, :-1, :-1])
    slope = np.einsum("bij,bj->bi", inv, s[:, :-1, -1])
    icpt = m[:, -1] - np.einsum("bi,bi->b", slope, m[:, :-1])
    rss = np.maximum(s[:, -1, -1] - np.einsum("bi,bi->b", slope, s[:, :-1, -1]), 0) * nv
    with np.errstate(all="ignore"):
        s2 = rss / np.where(nv - k > 0, nv - k, np.nan)
        r2 = 1 - rss / (s[:, -1, -1] * nv)
        var = np.einsum("bii->bi", inv) / nv[:, None] * s2[:, None]
        var0 = s2 / nv * (1 + np.einsum("bi,bij,bj->b", m[:, :-1], inv, m[:, :-1]))
        se = np.sqrt(np.column_stack([var0, var]))
    beta = np.column_stack([icpt, slope])
    return pd.DataFrame({"beta": list(beta), "se": list(se), "r2": r2, "sigma": np.sqrt(s2), "rss": rss})


def fit(df: DataFrame, y: str, xs, by=()) -> DataFrame:
    """One row per group: n and the fitted struct. Rows with a missing value are dropped listwise."""
    by, xs = _list(by), list(xs)
    rows = df.na.drop(subset=[*xs, y])
    m = rows.groupBy(*by).agg(*moments([*xs, y])) if len(xs) <= 5 else shifted_moments(rows, [*xs, y], by)
    m = m.where(F.col("n") > len(xs) + 1)
    return m.select(*by, F.col("n").cast("long").alias("n"), _fit("n", "means", "cov").alias("f"))


def ols(df: DataFrame, y: str, xs, fit_where: Column | None = None, by=()) -> DataFrame:
    """Long coefficient table with classical standard errors and t p-values."""
    xs = list(xs)
    f = fit(df if fit_where is None else df.where(fit_where), y, xs, by)
    long = f.select(*_list(by), "n", F.col("f.r2").alias("r2"), F.col("f.sigma").alias("resid_sd"), F.posexplode(
        F.arrays_zip(F.array(*[F.lit(t) for t in ["intercept", *xs]]).alias("term"), F.col("f.beta").alias("beta"), F.col("f.se").alias("se"))))
    out = long.select(*_list(by), F.col("col.term").alias("term"), F.col("col.beta").alias("estimate"), F.col("col.se").alias("se"), "r2", "resid_sd", "n")
    return out.withColumn("p", student_two_sided_p(safe_div("estimate", "se"), F.col("n").cast("double") - (len(xs) + 1)))


def _attach(df: DataFrame, f: DataFrame, by) -> tuple[DataFrame, Column]:
    by = _list(by)
    if by:
        return df.join(f.select(*by, F.col("f.beta").alias("__beta")), by, "left"), F.col("__beta")
    return df.withColumn("__beta", f.select(F.col("f.beta")).scalar()), F.col("__beta")


def predict(df: DataFrame, y: str, xs, fit_where: Column | None = None, by=(), fitted: str = "fitted", resid: str = "resid") -> DataFrame:
    """Fit where fit_where holds, apply to every row."""
    f = fit(df if fit_where is None else df.where(fit_where), y, list(xs), by)
    out, b = _attach(df, f, by)
    value = F.get(b, F.lit(0))
    for i, x in enumerate(xs):
        value = value + F.get(b, F.lit(i + 1)) * F.col(x)
    return out.withColumn(fitted, value).withColumn(resid, F.col(y) - F.col(fitted)).drop("__beta")


def partial_residuals(df: DataFrame, y: str, x: str, others, by=()) -> DataFrame:
    """y and x both residualised on the other predictors."""
    both = df.na.drop(subset=[y, x, *others])
    a = predict(both, y, others, by=by, fitted="__fy", resid="y_resid")
    return predict(a, x, others, by=by, fitted="__fx", resid="x_resid").drop("__fy", "__fx")


def hac_slope(df: DataFrame, y: str, x: str, order: str, by=(), lags: int = 7) -> DataFrame:
    """One-regressor OLS with Newey-West (Bartlett) standard error over row order, all as columns.

    No small-sample factor; normal p-value. Groups are series of nights.
    """
    by = _list(by)
    part = by or [F.lit(0)]
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w, wo = W.partitionBy(*part), W.partitionBy(*part).orderBy(order)
    rows = rows.withColumns({"__mx": F.avg(x).over(w), "__my": F.avg(y).over(w), "__vx": F.var_pop(x).over(w),
                             "__cxy": F.covar_pop(x, y).over(w)})
    b = safe_div("__cxy", "__vx")
    e = F.col(y) - F.col("__my") - b * (F.col(x) - F.col("__mx"))
    rows = rows.withColumns({"__b": b, "__e": e})
    rows = rows.withColumn("__z", (F.col(x) - F.col("__mx")) * F.col("__e"))
    near = F.col("__z") / 2
    for l in range(1, lags + 1):
        near = near + F.coalesce(F.lag("__z", l).over(wo), F.lit(0.0)) * (1 - l / (lags + 1))
    rows = rows.withColumn("__s", near)
    n = F.count("*").cast("double")
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("__b").alias("beta"), (2 * F.sum(F.col("__z") * F.col("__s"))).alias("__meat"),
        (n * F.first("__vx")).alias("__sxx"), F.sum(F.col("__e") * F.col("__e")).alias("__rss"), (n * F.var_pop(y)).alias("__tss"))
    g = g.withColumn("se", safe_div(F.sqrt(F.greatest(F.lit(0.0), F.col("__meat"))), "__sxx"))
    return g.select(*by, "beta", "se", normal_two_sided_p(safe_div("beta", "se")).alias("p"),
                    (1 - safe_div("__rss", "__tss")).alias("r2"), "n")


@F.pandas_udf(_VECTOR)
def _sandwich(n: pd.Series, means: pd.Series, cov: pd.Series, meat: pd.Series) -> pd.Series:
    """Diagonal of the HAC covariance on the uncentred design (intercept first), as standard errors."""
    nv, m = n.to_numpy(float), np.vstack(means.to_numpy()).astype(float)[:, :-1]
    k = m.shape[1]
    s = _square(np.vstack(cov.to_numpy()).astype(float), k + 1)[:, :-1, :-1]
    xtx = np.zeros((len(nv), k + 1, k + 1))
    xtx[:, 0, 0] = 1
    xtx[:, 0, 1:] = xtx[:, 1:, 0] = m
    xtx[:, 1:, 1:] = s + m[:, :, None] * m[:, None, :]
    bread = _pinv(xtx * nv[:, None, None])
    half = np.vstack(meat.to_numpy()).astype(float).reshape(len(nv), k + 1, k + 1)
    v = bread @ (half + half.transpose(0, 2, 1)) @ bread
    return pd.Series(list(np.sqrt(np.maximum(np.einsum("bii->bi", v), 0))))


def hac_ols(df: DataFrame, y: str, xs, order: str, by=(), lags: int = 7, rank: bool = False) -> DataFrame:
    """Several-regressor OLS with Newey-West standard errors, normal p-values, lags over row order.

    rank replaces every variable by its standardised rank first. The meat is
    sum u_i s_i' plus its transpose, with u_i = x_i e_i and s_i half of u_i plus
    the Bartlett-weighted earlier u: one window pass, then k*k sums.
    """
    by, xs = _list(by), list(xs)
    rows = df.na.drop(subset=[*xs, y])
    if rank:
        from duskline.operators.ranks import rank_z

        rows = rank_z(rows, [*xs, y], by, "__rz_")
        rows = rows.withColumns({c: F.col(f"__rz_{c}") for c in [*xs, y]})
    base = rows.groupBy(*by).agg(*moments([*xs, y])).where(F.col("n") > len(xs) + 1)
    f = base.select(*by, "n", "means", "cov", _fit("n", "means", "cov").alias("f"))
    out, b = _attach(rows, f, by)
    e = F.col(y) - F.get(b, F.lit(0))
    for i, x in enumerate(xs):
        e = e - F.get(b, F.lit(i + 1)) * F.col(x)
    out = out.where(b.isNotNull()).withColumn("__e", e)
    out = out.withColumns({f"__u{i}": (F.lit(1.0) if i == 0 else F.col(xs[i - 1])) * F.col("__e") for i in range(len(xs) + 1)})
    wo = W.partitionBy(*(by or [F.lit(0)])).orderBy(order)

    def near(u: str) -> Column:
        acc = F.col(u) / 2
        for l in range(1, lags + 1):
            acc = acc + F.coalesce(F.lag(u, l).over(wo), F.lit(0.0)) * (1 - l / (lags + 1))
        return acc

    k = len(xs) + 1
    out = out.withColumns({f"__s{i}": near(f"__u{i}") for i in range(k)})
    meat = out.groupBy(*by).agg(F.array(*[F.sum(F.col(f"__u{i}") * F.col(f"__s{j}")) for i in range(k) for j in range(k)]).alias("meat"))
    j = f.join(meat, by) if by else f.withColumn("meat", meat.scalar())
    j = j.select(*by, F.col("n").cast("long").alias("n"), F.col("f.r2").alias("r2"), F.inline(F.arrays_zip(
        F.array(*[F.lit(t) for t in ["intercept", *xs]]).alias("term"), F.col("f.beta").alias("beta"),
        _sandwich("n", "means", "cov", "meat").alias("se"))))
    return j.withColumn("p", normal_two_sided_p(safe_div("beta", "se")))


def natural_spline(x, knots) -> list[Column]:
    """Natural cubic spline basis (truncated powers, linear beyond the end knots), without the constant."""
    x = F.col(x) if isinstance(x, str) else x
    k = [float(v) for v in knots]
    cube = lambda v: F.pow(F.greatest(F.lit(0.0), v), F.lit(3.0))
    d = lambda j: (cube(x - k[j]) - cube(x - k[-1])) / (k[-1] - k[j])
    return [x] + [d(j) - d(len(k) - 2) for j in range(len(k) - 2)]


def spline_curve(df: DataFrame, t: str, warmth: str, y: str, knots, levels: dict[str, Column], grid, by=()) -> DataFrame:
    """Curve of y in time whose shape changes with warmth, predicted at given warmth levels.

    The design is [basis, basis * warmth] plus a constant and a warmth offset,
    which spans the same space as a full-rank spline basis and its interaction.
    """
    by = _list(by)
    basis = natural_spline(t, knots)
    names = [f"__b{i}" for i in range(len(basis))]
    rows = df.withColumns(dict(zip(names, basis)))
    rows = rows.withColumns({"__w": F.col(warmth), **{f"{n}w": F.col(n) * F.col(warmth) for n in names}})
    xs = [*names, "__w", *[f"{n}w" for n in names]]
    f = fit(rows, y, xs, by)
    # the prediction grid is fixed; it is attached to each group's coefficients
    pts = f.select(*by, "n", F.col("f.r2").alias("r2"), F.col("f.beta").alias("__beta"),
                   F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("t"))
    pts = pts.withColumn("__lv", F.explode(F.array(*[
        F.struct(F.lit(name).alias("level"), v.cast("double").alias("w")) for name, v in levels.items()])))
    gb = natural_spline("t", knots)
    w = F.col("__lv.w")
    terms = [*gb, w, *[g * w for g in gb]]
    pred = F.get("__beta", F.lit(0))
    for i, term in enumerate(terms):
        pred = pred + F.get("__beta", F.lit(i + 1)) * term
    return pts.select(*by, F.col("__lv.level").alias("level"), "t", pred.alias("predicted"), "r2", "n")


class _Decays:
    """Tails of several groups, padded; least squares in floor and amplitude within [0, top] for a tau of each group."""

    def __init__(self, t: list, y: list, top: float):
        n = max(map(len, t))
        self.w, self.t, self.y = (np.zeros((len(t), n)) for _ in range(3))
        for i, (a, b) in enumerate(zip(t, y, strict=True)):
            self.w[i, :len(a)], self.t[i, :len(a)], self.y[i, :len(b)] = 1, a, b
        self.n, self.top = self.w.sum(1), top
        self.spread = (self.w * (self.y - (self.w * self.y).sum(1, keepdims=True) / self.n[:, None]) ** 2).sum(1)

    def solve(self, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(error, floor, amplitude): the interior solution if it is inside, else the best edge."""
        e = np.exp(-self.t / tau[:, None]) * self.w
        s = lambda v: (self.w * v).sum(1)
        me, my, ee, ey = s(e) / self.n, s(self.y) / self.n, s(e * e) / self.n, s(e * self.y) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            free = np.nan_to_num((ey - me * my) / (ee - me * me))
            pairs = [(my - free * me, free)]
            pairs += [(np.full(len(tau), c), np.clip((ey - c * me) / ee, 0, self.top)) for c in (0.0, self.top)]
            pairs += [(np.clip(my - c * me, 0, self.top), np.full(len(tau), c)) for c in (0.0, self.top)]
        best = np.full(len(tau), np.inf), np.zeros(len(tau)), np.zeros(len(tau))
        for fl, a in pairs:
            err = (self.w * (self.y - fl[:, None] - a[:, None] * e) ** 2).sum(1)
            inside = (fl >= 0) & (fl <= self.top) & (a >= 0) & (a <= self.top) & (err < best[0])
            best = tuple(np.where(inside, new, old) for new, old in zip((err, fl, a), best, strict=True))
        return best

    def slope(self, tau: np.ndarray) -> np.ndarray:
        """Derivative of the profiled error in log tau: floor and amplitude are at their optimum, so only the exponential moves."""
        _, fl, a = self.solve(tau)
        e = np.exp(-self.t / tau[:, None]) * self.w
        r = self.w * (self.y - fl[:, None] - a[:, None] * e)
        return -2 * (r * a[:, None] * e * self.t / tau[:, None]).sum(1)


def _project(t: list, y: list, bounds: tuple[float, float], top: float, points: int = 48, rounds: int = 60) -> list[tuple]:
    """tau, floor, amplitude and R2 of each group by variable projection.

    A coarse scan of log tau brackets the least error; inside the bracket a secant (Newton)
    step on the slope is taken where it stays inside, else the middle.
    """
    d = _Decays(t, y, top)
    grid = np.linspace(np.log(bounds[0]), np.log(bounds[1]), points)
    err = np.stack([d.solve(np.full(len(t), np.exp(g)))[0] for g in grid])
    at = err.argmin(0)
    lo, hi = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, points - 1)]
    s_lo, s_hi = d.slope(np.exp(lo)), d.slope(np.exp(hi))
    for i in range(rounds):
        with np.errstate(divide="ignore", invalid="ignore"):
            step = lo - s_lo * (hi - lo) / (s_hi - s_lo)
        wide = hi - lo
        mid = np.where(np.isfinite(step) & (step > lo + 0.01 * wide) & (step < hi - 0.01 * wide) & (i % 3 != 2), step, (lo + hi) / 2)
        s_mid = d.slope(np.exp(mid))
        left = s_mid < 0  # the error still falls: the least lies to the right
        lo, s_lo, hi, s_hi = np.where(left, mid, lo), np.where(left, s_mid, s_lo), np.where(left, hi, mid), np.where(left, s_hi, s_mid)
    tries = [np.exp(x) for x in ((lo + hi) / 2, np.full(len(t), grid[0]), np.full(len(t), grid[-1]), grid[at])]
    errs = np.stack([d.solve(x)[0] for x in tries])
    tau = np.stack(tries)[np.argmin(np.round(errs, 14), axis=0), np.arange(len(t))]
    e, fl, a = d.solve(tau)
    with np.errstate(divide="ignore", invalid="ignore"):
        return list(zip(tau.tolist(), fl.tolist(), a.tolist(), np.where(d.spread > 0, 1 - e / d.spread, np.nan).tolist(), strict=True))


def relaxation(df: DataFrame, by, t: str, y: str, bounds=(0.3, 30.0), min_points: int = 8, min_r2: float = 0.3, top: float = 3.0) -> DataFrame:
    """Exponential relaxation y = floor + A exp(-(t - t_peak) / tau) after the (first) peak, tau continuous within bounds.

    A group is one profile: its tail is one array, and a batch of profiles is
    fitted at once. floor and A stay in [0, top]; fits of R2 up to min_r2 are left out.
    """
    by = _list(by)
    curve = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y")))).alias("c"))
    peak = F.array_max(F.transform("c", lambda p: F.struct(p["y"].alias("y"), (-p["t"]).alias("t"))))
    curve = curve.withColumn("peak_t", -peak["t"])
    curve = curve.withColumn("c", F.filter("c", lambda p: p["t"] >= F.col("peak_t"))).where(F.size("c") >= min_points)

    @F.pandas_udf("tau double, floor double, amplitude double, fit_r2 double")
    def fit_all(ts: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = _project(list(ts), list(ys), bounds, top) if len(ts) else []
        return pd.DataFrame(rows, columns=["tau", "floor", "amplitude", "fit_r2"], dtype=float)

    fitted = curve.withColumn("f", fit_all(F.transform("c", lambda p: p["t"] - F.col("peak_t")), F.transform("c", lambda p: p["y"])))
    return fitted.select(*by, "peak_t", "f.*", F.size("c").cast("long").alias("n_tail")).where((F.col("fit_r2") > min_r2) & ~F.isnan("fit_r2"))


def pred_metrics(df: DataFrame, obs: str, pred: str, by=(), sd: str | None = None, target_se: str | None = None) -> DataFrame:
    """R2, RMSE, MAE, rank correlation, and interval coverage and width with and without the target's own error.

    Groups of any size: ranks come from value ranges, not from one sorted group.
    """
    from duskline.operators.ranks import spread_rank

    by = _list(by)
    d = F.col(obs) - F.col(pred)
    ok = df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull())
    ok = settled(ok.select(*by, obs, pred, *[c for c in (sd, target_se) if c]))
    aggs = [F.count("*").alias("n"), (1 - safe_div(F.avg(d * d), F.var_pop(obs))).alias("r2"),
            F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae")]
    if sd:
        inside = lambda s: F.avg((F.abs(d) <= 1.96 * s).cast("double"))
        aggs += [inside(F.col(sd)).alias("coverage"), F.avg(3.92 * F.col(sd)).alias("width")]
        if target_se:
            s2 = F.sqrt(F.col(sd) * F.col(sd) + F.col(target_se) * F.col(target_se))
            aggs += [inside(s2).alias("coverage_target"), F.avg(3.92 * s2).alias("width_target")]
    main = ok.groupBy(*by).agg(*aggs)
    ranked = spread_rank(spread_rank(ok.select(*by, obs, pred), obs, by, "__ro"), pred, by, "__rp")
    r = F.corr("__ro", "__rp")
    rho = ranked.groupBy(*by).agg(F.when(~F.isnan(r), r).alias("rho"))
    return main.join(rho, by) if by else main.withColumn("rho", rho.select("rho").scalar())


def cv_summary(metrics: DataFrame, cols, ps=(0.025, 0.5, 0.975)) -> DataFrame:
    """Quantile rows of cross-validation metrics over repeats: metric, p, value."""
    row = metrics.agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in ps])).alias(c) for c in cols])
    long = row.unpivot([], list(cols), "metric", "q")
    return long.select("metric", F.inline(F.arrays_zip(F.array(*[F.lit(float(p)) for p in ps]).alias("p"), F.col("q").alias("value"))))
