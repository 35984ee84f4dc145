"""Association, regression, resampling and survival against NumPy and hand results."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duskline.operators import association as at
from duskline.operators import panel, series, survival
from duskline.operators import regression as rg
from duskline.operators import resample as rs


@pytest.fixture(scope="module")
def nights(spark):
    rng = np.random.default_rng(5)
    n = 60
    pdf = pd.DataFrame({"i": np.arange(n), "g": np.repeat(["a", "b"], n // 2), "x": rng.normal(size=n), "c1": rng.normal(size=n), "c2": rng.normal(size=n)})
    pdf["y"] = 0.5 * pdf.x - 0.7 * pdf.c1 + rng.normal(size=n)
    pdf.loc[3, "c1"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("c1", F.when(~F.isnan("c1"), F.col("c1")))
    return pdf, df.cache()


def ref_partial(p, covs):
    r = p[["x", "y", *covs]].dropna().rank().to_numpy()
    z = np.column_stack([np.ones(len(r)), r[:, 2:]])
    e = r[:, :2] - z @ np.linalg.lstsq(z, r[:, :2], rcond=None)[0]
    return np.corrcoef(e.T)[0, 1]


def test_partial_spearman_equals_residual_regression(nights):
    pdf, df = nights
    got = {r.g: r.rho for r in at.partial_spearman(df, "x", "y", ("c1", "c2"), ["g"]).collect()}
    for g, p in pdf.groupby("g"):
        assert abs(got[g] - ref_partial(p, ["c1", "c2"])) < 1e-10


def test_partial_spearman_with_switched_off_covariate(nights):
    pdf, df = nights
    d = at.spec_rows(df, [{"s": "with", "u": True}, {"s": "without", "u": False}])
    got = {r.s: (r.rho, r.n) for r in at.partial_spearman(d, "x", "y", ("c1",), ["s"], use={"c1": F.col("u")}).collect()}
    assert abs(got["with"][0] - ref_partial(pdf, ["c1"])) < 1e-10 and got["with"][1] == 59
    assert abs(got["without"][0] - ref_partial(pdf, [])) < 1e-10 and got["without"][1] == 60


def test_collinear_covariate_is_skipped(nights):
    pdf, df = nights
    d = df.withColumn("c3", F.col("c2") * 3)
    a = at.partial_spearman(d, "x", "y", ("c2", "c3")).first().rho
    assert abs(a - ref_partial(pdf, ["c2"])) < 1e-8


def test_rank_residuals_give_the_same_correlation(nights):
    pdf, df = nights
    r = at.rank_residuals(df, "x", "y", ("c1", "c2"), ["g"], keep=("i",))
    got = {v.g: v.r for v in at.pearson(r, "rx", "ry", ["g"]).collect()}
    for g, p in pdf.groupby("g"):
        assert abs(got[g] - ref_partial(p, ["c1", "c2"])) < 1e-10


def test_stratified_shift_test_by_enumeration(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"i": range(15), "g": np.repeat([1, 2, 3], 5), "x": rng.permutation(15) + 1.0, "y": np.round(rng.permutation(15) / 2) + 1.0})
    x, y = pdf.x - pdf.x.mean(), pdf.y - pdf.y.mean()
    parts = [[np.dot(x[pdf.g == g], np.roll(y[pdf.g == g], s)) for s in range(5)] for g in (1, 2, 3)]
    sums = np.array([sum(c) for c in itertools.product(*parts)])
    want = np.mean(np.abs(sums) >= abs(np.dot(x, y)) - 1e-9)
    r = at.stratified_shift_p(spark.createDataFrame(pdf), "x", "y", "i", "g").first()
    assert abs(r.p_shift - want) < 1e-12 and r.n_randomizations == 125


def test_shift_test_of_one_series(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=12), rng.normal(size=12)
    null = np.array([np.corrcoef(x, np.roll(y, s))[0, 1] for s in range(12)])
    r = at.shift_p(spark.createDataFrame(list(zip(range(12), x.tolist(), y.tolist())), "i long, x double, y double"), "x", "y", "i").first()
    assert abs(r.p_shift - np.mean(np.abs(null) >= abs(null[0]) - 1e-9)) < 1e-12


def test_long_series_is_not_refused(spark):
    df = spark.range(4100).select("id", F.sin("id").alias("x"), F.sin(F.col("id") + 1).alias("y"))
    assert 0 < at.shift_p(df, "x", "y", "id").first()["p_shift"] < 1


def test_bh(frame):
    df = frame("k long, p double", [(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5), (5, None)])
    r = [x.p_bh for x in at.bh_adjust(df, "p").orderBy("k").collect()]
    assert np.allclose(r[:4], [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5]) and r[4] is None


def test_ols_against_lstsq(nights):
    pdf, df = nights
    d = pdf.dropna()
    X = np.column_stack([np.ones(len(d)), d.x, d.c1, d.c2])
    b, rss = np.linalg.lstsq(X, d.y, rcond=None)[:2]
    s2 = rss[0] / (len(d) - 4)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)
    r = {x.term: x for x in rg.ols(df, "y", ["x", "c1", "c2"]).collect()}
    names = ["intercept", "x", "c1", "c2"]
    assert np.allclose([r[k].estimate for k in names], b) and np.allclose([r[k].se for k in names], se)
    assert 0 <= r["c1"].p < 0.01


def newey_west(X, y, L):
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    u = X * (y - X @ b)[:, None]
    m = u.T @ u
    for l in range(1, L + 1):
        g = u[l:].T @ u[:-l]
        m += (1 - l / (L + 1)) * (g + g.T)
    inv = np.linalg.inv(X.T @ X)
    return b, np.sqrt(np.diag(inv @ m @ inv))


def test_hac_multi_and_single(nights):
    pdf, df = nights
    d = pdf.dropna()
    b, se = newey_west(np.column_stack([np.ones(len(d)), d.x, d.c1]), d.y.to_numpy(), 5)
    r = {x.term: x for x in rg.hac_ols(df, "y", ["x", "c1"], "i", lags=5).collect()}
    assert np.allclose([r[k].beta for k in ("intercept", "x", "c1")], b) and np.allclose([r[k].se for k in ("intercept", "x", "c1")], se)
    b, se = newey_west(np.column_stack([np.ones(60), pdf.x]), pdf.y.to_numpy(), 7)
    r = rg.hac_slope(df, "y", "x", "i", lags=7).first()
    assert np.allclose([r.beta, r.se], [b[1], se[1]]) and abs(r.p - math.erfc(abs(b[1] / se[1]) / math.sqrt(2))) < 1e-7


def test_partial_residuals(nights):
    pdf, df = nights
    r = rg.partial_residuals(df, "y", "x", ["c2"]).toPandas().sort_values("i")
    Z = np.column_stack([np.ones(60), pdf.c2])
    for c, k in (("y", "y_resid"), ("x", "x_resid")):
        assert np.allclose(r[k], pdf[c] - Z @ np.linalg.lstsq(Z, pdf[c], rcond=None)[0])


def test_natural_spline_rank_and_linearity(spark):
    knots = (0.0, 2.25, 4.5, 6.75, 9.0)
    grid = [i / 4 for i in range(37)]
    df = spark.createDataFrame([(g,) for g in grid], "t double").select("t", *[b.alias(f"b{i}") for i, b in enumerate(rg.natural_spline("t", knots))])
    m = df.orderBy("t").drop("t").toPandas().to_numpy()
    assert np.linalg.matrix_rank(np.column_stack([np.ones(37), m])) == 5
    tail = spark.createDataFrame([(v,) for v in (10.0, 11.0, 12.0)], "t double").select(*rg.natural_spline("t", knots)).toPandas().to_numpy()
    assert np.allclose(tail[2] - tail[1], tail[1] - tail[0])


def test_relaxation_recovers_tau(spark):
    t = np.arange(0, 9.01, 0.25)
    y = 0.4 + 1.2 * np.exp(-t / 2.0)
    r = rg.relaxation(spark.createDataFrame([(1, a, b) for a, b in zip(t.tolist(), y.tolist())], "night long, t double, y double"), "night", "t", "y").first()
    assert abs(r.tau - 2.0) < 1e-7 and abs(r.floor - 0.4) < 1e-7 and abs(r.amplitude - 1.2) < 1e-7 and r.fit_r2 > 0.999


def test_relaxation_reaches_the_least_error_within_bounds(spark):
    rng = np.random.default_rng(7)
    t = np.arange(0, 6.01, 0.25)
    rows, curves = [], {}
    for g, (f, a, tau) in enumerate([(0.2, 1.0, 0.4), (0.0, 2.5, 1.7), (1.0, 0.3, 12.0), (2.9, 3.0, 3.0), (0.5, 0.0, 1.0), (0.0, 3.0, 29.0)]):
        y = np.r_[4.0, f + a * np.exp(-t[1:] / tau) + rng.normal(scale=0.05, size=len(t) - 1)]
        curves[g] = y
        rows += [(g, float(u), float(v)) for u, v in zip(t, y, strict=True)]
    got = {r.g: r for r in rg.relaxation(spark.createDataFrame(rows, "g long, t double, y double"), "g", "t", "y", min_r2=float("-inf")).collect()}
    assert got.keys() == curves.keys()
    for g, y in curves.items():
        def err(tau, y=y):
            e = np.exp(-t / tau)
            cands = [np.linalg.lstsq(np.column_stack([np.ones_like(e), e]), y, rcond=None)[0]]
            cands += [(c, np.clip(((y - c) @ e) / (e @ e), 0, 3)) for c in (0, 3)] + [(np.clip((y - c * e).mean(), 0, 3), c) for c in (0, 3)]
            return min(((y - fl - a * e) ** 2).sum() for fl, a in cands if -1e-12 <= fl <= 3 and -1e-12 <= a <= 3)
        best = min(err(x) for x in np.exp(np.linspace(np.log(0.3), np.log(30), 20_000)))
        r = got[g]
        assert 0.3 - 1e-9 <= r.tau <= 30 + 1e-9 and 0 <= r.floor <= 3 and 0 <= r.amplitude <= 3
        assert err(r.tau) <= best + 1e-9


def test_kaplan_meier(frame):
    df = frame("g long, t double, c boolean", [(1, 1.0, False), (1, 1.0, True), (1, 2.0, False), (1, 3.0, False), (1, 3.0, True)])
    s = [round(r.survival, 6) for r in survival.km_curve(df, "g", "t", "c").orderBy("t").collect()]
    assert s == [0.8, round(0.8 * 2 / 3, 6), round(0.8 * 2 / 3 / 2, 6)]
    assert survival.km_median(df, "g", "t", "c").first().km_median == 3.0
    none = frame("g long, t double, c boolean", [(1, 1.0, True), (1, 2.0, True)])
    assert survival.km_median(none, "g", "t", "c").first().km_median is None
    dead = frame("g long, t double, c boolean", [(1, 1.0, False)])
    assert survival.km_median(dead, "g", "t", "c").first().km_median == 1.0


def test_block_draws_stay_inside_the_season(spark):
    cal = panel.calendar_spine(spark, (2001, 2002))
    d = rs.block_draws(cal, 20, "s", 14).groupBy("replicate", "year").agg(F.sum("times").alias("n"), F.min("day_index").alias("a"), F.max("day_index").alias("b")).collect()
    assert len(d) == 40 and all(r.n == 92 and r.a >= 0 and r.b <= 91 for r in d)
    assert sorted(map(tuple, rs.block_draws(cal, 3, "s").collect())) == sorted(map(tuple, rs.block_draws(cal.repartition(7), 3, "s").collect()))


def test_cluster_bootstrap_brackets_the_estimate(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"year": np.repeat(range(6), 30), "grp": np.tile(["h", "l"], 90), "v": rng.normal(size=180)})
    pdf.loc[pdf.grp == "h", "v"] += 1
    r = rs.cluster_boot_diff(spark.createDataFrame(pdf), "v", "grp", "h", "l", "year", 200, "z").first()
    assert r.ci_low <= r["diff"] <= r.ci_high and abs(r["diff"] - (pdf[pdf.grp == "h"].v.mean() - pdf[pdf.grp == "l"].v.mean())) < 1e-9
    assert 1 / 201 <= r.p_boot <= 1


def test_stationary_draws_cover_each_position_once(spark):
    s = spark.range(30).select(F.lit(1999).alias("year"), F.col("id").cast("int").alias("position"))
    d = rs.stationary_draws(s, 5, "q").groupBy("replicate").agg(F.count("*").alias("n"), F.max("position").alias("m")).collect()
    assert all(r.n == 30 and r.m <= 29 for r in d)


def test_profile_completeness_and_integral(frame):
    full = [(1, i / 4, 1.0 + i) for i in range(5)]
    gap = [(2, i / 4, 1.0) for i in range(5) if i != 2]
    df = frame("n long, t double, y double", full + gap)
    c = {r.n: r.complete for r in series.complete(df, "n", "t", 0.0, 1.0).collect()}
    assert c == {1: True, 2: False}
    integ = {r.n: r.integral for r in series.trapezoid(df, "n", "t", "y").collect()}
    assert abs(integ[1] - np.trapezoid([1, 2, 3, 4, 5], dx=0.25)) < 1e-12


def test_tail_slope_starts_at_first_peak(frame):
    y = [1, 5, 5, 4, 3, 2, 1]
    r = series.tail_slope(frame("n long, t double, y double", [(1, float(i), float(v)) for i, v in enumerate(y)]), "n", "t", "y").first()
    assert r.tail_start == 1.0 and r.n_tail == 6 and abs(r.tail_slope - np.polyfit(range(1, 7), y[1:], 1)[0]) < 1e-12


def test_interpolation_limits_and_long_gaps(frame):
    t0 = dt.datetime(2024, 1, 1, 23, 50)
    rows = [("a", t0, 0.0), ("a", t0 + dt.timedelta(minutes=10), 10.0), ("a", t0 + dt.timedelta(days=3), 30.0)]
    out = series.interpolate(frame("s string, ts timestamp_ntz, v double", rows), "s", "ts", "v").toPandas().set_index("ts").value
    assert out[dt.datetime(2024, 1, 1, 23, 55)] == 5.0 and out[dt.datetime(2024, 1, 2, 0, 0)] == 10.0
    filled = out.dropna()
    after = [m for m in filled.index if dt.datetime(2024, 1, 2) < m < t0 + dt.timedelta(days=3)]
    assert len(after) == 3
    span = dt.timedelta(days=3) - dt.timedelta(minutes=10)
    assert abs(filled[after[0]] - (10 + 20 * (dt.timedelta(minutes=5) / span))) < 1e-9
    assert len(filled[filled.index > t0 + dt.timedelta(days=3)]) == 1


def test_two_level_accumulation(frame):
    df = frame("s string, d long, v double", [("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 3.0), ("b", 1, 4.0), ("c", 1, 5.0), ("c", 1, None)])
    assert panel.areal_mean_total(df, "s", "d", "v", "t").first().t == (3 + 7 + 5) / 3


def test_many_predictors_take_the_shifted_path(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(80, 7)) + 1e5
    y = X @ np.arange(7) + rng.normal(size=80)
    cols = [f"x{i}" for i in range(7)]
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([X, y]), columns=[*cols, "y"]))
    got = {r.term: r.estimate for r in rg.ols(df, "y", cols).collect()}
    c = X - X.mean(0)
    want = np.linalg.lstsq(c, y - y.mean(), rcond=None)[0]
    assert np.allclose([got[k] for k in cols], want, atol=1e-4)


def test_rank_hac_uses_standardised_ranks(nights):
    pdf, df = nights
    r = pdf[["x", "y"]].rank()
    z = ((r - r.mean()) / r.std(ddof=0)).to_numpy()
    b, se = newey_west(np.column_stack([np.ones(60), z[:, 0]]), z[:, 1], 4)
    got = {v.term: v for v in rg.hac_ols(df, "y", ["x"], "i", lags=4, rank=True).collect()}
    assert abs(got["x"].beta - b[1]) < 1e-10 and abs(got["x"].se - se[1]) < 1e-10


def test_spline_curve_and_its_bootstrap_agree_with_lstsq(spark):
    rng = np.random.default_rng(3)
    cal = panel.calendar_spine(spark, (2001,))
    days = [dt.date(2001, 6, 1) + dt.timedelta(days=i) for i in range(92)]
    rows = [(d, float(t), float(w), float(1 + w * t / 9 + rng.normal() * 0.1)) for d, w in zip(days, rng.normal(size=92)) for t in np.arange(0, 9.1, 1.5)]
    curve = spark.createDataFrame(rows, "night_date date, t double, w double, y double")
    knots = (0.0, 3.0, 6.0, 9.0)
    levels = {"mean": F.lit(0.0), "warm": F.lit(1.0)}
    point = {(r.level, r.t): r.predicted for r in rg.spline_curve(curve, "t", "w", "y", knots, levels, [0.0, 4.5, 9.0]).collect()}
    basis = spark.createDataFrame([(r[1],) for r in rows], "t double").select(*rg.natural_spline("t", knots)).toPandas().to_numpy()
    w, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    D = np.column_stack([np.ones(len(w)), basis, w, basis * w[:, None]])
    b = np.linalg.lstsq(D, y, rcond=None)[0]
    g = spark.createDataFrame([(0.0,), (4.5,), (9.0,)], "t double").select(*rg.natural_spline("t", knots)).toPandas().to_numpy()
    for lv, wv in (("mean", 0.0), ("warm", 1.0)):
        want = np.column_stack([np.ones(3), g, np.full(3, wv), g * wv]) @ b
        assert np.allclose([point[lv, t] for t in (0.0, 4.5, 9.0)], want, atol=1e-8)
    band = rs.block_boot_spline(cal, curve, "t", "w", "y", knots, levels, [0.0, 4.5, 9.0], 20, "b").collect()
    assert len(band) == 6
    for r in band:
        assert abs(r.fit - point[r.level, r.t]) < 1e-6 and r.ci_low <= r.ci_high and r.n_valid == 20


def test_cv_summary_quantiles(frame):
    m = frame("repeat long, r2 double", [(i, i / 10) for i in range(11)])
    got = {r.p: r.value for r in rg.cv_summary(m, ["r2"]).collect()}
    assert np.allclose([got[0.025], got[0.5], got[0.975]], [0.025, 0.5, 0.975])
