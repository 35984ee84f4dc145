"""Neighbours, inverse distance, fixed effects, fields and blocked ridge."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duskline.operators import neighbours as nb
from duskline.operators import spatial as sp


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(4)
    n = 400
    xy = np.round(rng.normal(size=(n, 2)) * 100, 1)
    xy[:140] = xy[0]  # a third of all points share one place
    s = pd.DataFrame({"sid": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "v": rng.normal(size=n)})
    q = pd.DataFrame({"q": np.arange(150), "cx": rng.normal(size=150) * 150, "cy": rng.normal(size=150) * 150})
    return s, q, spark.createDataFrame(s), spark.createDataFrame(q)


@pytest.mark.parametrize("per_tile", [2, 16, 10_000])
def test_nearest_is_exact(places, per_tile):
    s, q, sdf, qdf = places
    got = sp.nearest(qdf, sdf, "q", ("cx", "cy"), "sid", ("x", "y"), per_tile=per_tile).toPandas().sort_values("q")
    d2 = (q.cx.to_numpy()[:, None] - s.x.to_numpy()) ** 2 + (q.cy.to_numpy()[:, None] - s.y.to_numpy()) ** 2
    assert got.nearest_sid.tolist() == np.round(d2, 9).argmin(1).tolist()
    assert np.allclose(got.distance, np.sqrt(d2.min(1)))


def test_nearest_within_groups_and_before(spark):
    """Trees of several levels, one per group, with an order among the points; against all pairs."""
    rng = np.random.default_rng(12)
    n = 900
    p = pd.DataFrame({"g": np.where(np.arange(n) < 800, "a", "b"), "sid": np.arange(n), "x": rng.exponential(size=n), "y": rng.normal(size=n), "o": rng.permutation(n)})
    q = pd.concat([p.iloc[::9], pd.DataFrame({"g": ["c"], "sid": [7], "x": [0.0], "y": [0.0], "o": [5]})])
    trees = nb.forest(spark.createDataFrame(p), "sid", ("x", "y"), ["o"], ["g"], per_tile=4, copies=5, prefer="o")
    assert len(trees.levels) > 1
    got = nb.nearest_lists(spark.createDataFrame(q), "sid", ("x", "y"), trees, 5, before="o").collect()
    assert len(got) == len(q)
    for r in got:
        me = q[(q.sid == r.sid) & (q.g == r.g)].iloc[0]
        c = p[(p.g == me.g) & (p.o < me.o)]
        want = sorted(zip(np.round((c.x - me.x) ** 2 + (c.y - me.y) ** 2, 9), c.sid))[:5]
        assert [(b.d2, b.id) for b in r.best] == want


def test_nearest_plan_joins_on_nodes_and_collects_no_boxes(places):
    _, _, sdf, qdf = places
    out = sp.nearest(qdf, sdf, "q", ("cx", "cy"), "sid", ("x", "y"), per_tile=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "scalar-subquery" not in plan


def test_places_without_coordinates(frame):
    s = frame("sid long, x double, y double", [(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 0.0)])
    q = frame("q long, a double, b double", [(1, 5.0, 0.0), (2, None, 0.0)])
    assert [tuple(r) for r in sp.nearest(q, s, "q", ("a", "b"), "sid", ("x", "y")).collect()] == [(1, 1, 1, 5.0)]
    assert sp.nearest(q, s.limit(0), "q", ("a", "b"), "sid", ("x", "y")).count() == 0


def test_self_neighbours_skip_the_point_itself(places):
    s, _, sdf, _ = places
    got = sp.nearest(sdf, sdf, "sid", ("x", "y"), "sid", ("x", "y"), k=2, exclude_self=True, per_tile=16).toPandas()
    d2 = (s.x.to_numpy()[:, None] - s.x.to_numpy()) ** 2 + (s.y.to_numpy()[:, None] - s.y.to_numpy()) ** 2
    np.fill_diagonal(d2, np.inf)
    want = np.sqrt(np.sort(d2, axis=1)[:, :2])
    have = got.pivot(index="sid", columns="neighbour_rank", values="distance").to_numpy()
    assert np.allclose(have, want, atol=1e-6)


@pytest.mark.parametrize("per_tile", [50, 100_000])
def test_idw_matches_numpy(places, per_tile):
    s, q, sdf, qdf = places
    got = sp.idw(qdf, "q", ("cx", "cy"), sdf, "sid", ("x", "y"), "v", per_tile=per_tile).toPandas().sort_values("q").idw
    d = np.hypot(q.cx.to_numpy()[:, None] - s.x.to_numpy(), q.cy.to_numpy()[:, None] - s.y.to_numpy())
    w = np.maximum(d, 1e-9) ** -2.0
    assert np.allclose(got, (w @ s.v) / w.sum(1))


def test_idw_exact_hit_and_midpoint(frame):
    st = frame("s long, x double, y double, v double", [(1, 0.0, 0.0, 1.0), (2, 2.0, 0.0, 3.0)])
    q = frame("q long, a double, b double", [(1, 0.0, 0.0), (2, 1.0, 0.0)])
    got = [r.idw for r in sp.idw(q, "q", ("a", "b"), st, "s", ("x", "y"), "v").orderBy("q").collect()]
    assert got[0] == 1.0 and abs(got[1] - 2.0) < 1e-12


def test_two_way_effects_recover_a_balanced_panel(frame):
    rows = [(u, t, 10.0 + a + b) for u, a in (("p", -1.0), ("q", 1.0)) for t, b in ((1, 0.0), (2, 4.0))]
    u, t = sp.two_way_effects(frame("u string, t long, y double", rows), "u", "t", "y")
    assert {r.u: round(r.unit_effect, 9) for r in u.collect()} == {"p": -1.0, "q": 1.0}
    assert {r.t: round(r.time_effect, 9) for r in t.collect()} == {1: 10.0, 2: 14.0}


def test_two_way_effects_equal_dummy_regression(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame([(u, t) for u in range(6) for t in range(12) if rng.random() < 0.7], columns=["u", "t"])
    pdf["y"] = pdf.u * 0.7 - pdf.t * 0.2 + rng.normal(size=len(pdf))
    X = np.column_stack([pd.get_dummies(pdf.u).to_numpy(float), pd.get_dummies(pdf.t).to_numpy(float)[:, 1:]])
    b = np.linalg.lstsq(X, pdf.y, rcond=None)[0][:6]
    u, t = sp.two_way_effects(spark.createDataFrame(pdf), "u", "t", "y", tol=1e-6)
    got = u.toPandas().sort_values("u").unit_effect.to_numpy()
    assert np.allclose(got, b - b.mean(), atol=1e-4) and abs(got.mean()) < 1e-12
    exact = sp.two_way_effects(spark.createDataFrame(pdf), "u", "t", "y")[0].toPandas().sort_values("u").unit_effect.to_numpy()
    assert np.allclose(exact, b - b.mean(), atol=1e-11)


def test_effects_of_separate_components_and_groups(spark):
    """Two parts of the panel that share no time have effects of their own; `by` solves several panels at once."""
    rng = np.random.default_rng(3)
    rows = [(f, f"u{u}", t + 100 * (u >= 4), float(rng.normal())) for f in (0, 1) for u in range(8) for t in range(6) if rng.random() < 0.8]
    rows += [(1, "lone", 999, 5.0)]
    pdf = pd.DataFrame(rows, columns=["f", "u", "t", "y"])
    u, t = sp.two_way_effects(spark.createDataFrame(pdf), "u", "t", "y", by=["f"])
    u, t = u.toPandas(), t.toPandas()
    assert set(zip(u.f, u.component)) == {(0, "u0"), (0, "u4"), (1, "u0"), (1, "u4"), (1, "lone")}
    for (f, comp), part in u.groupby(["f", "component"]):
        assert abs(part.unit_effect.mean()) < 1e-12
        mine = pdf[(pdf.f == f) & pdf.u.isin(part.u)]
        x = np.column_stack([pd.get_dummies(mine.u).to_numpy(float), pd.get_dummies(mine.t).to_numpy(float)])
        fit = mine.u.map(part.set_index("u").unit_effect) + mine.t.map(t[(t.f == f) & (t.component == comp)].set_index("t").time_effect)
        assert np.allclose(fit, x @ np.linalg.lstsq(x, mine.y, rcond=None)[0], atol=1e-10)


def test_long_chain_is_one_component(frame):
    rows = [(f"u{i:03d}", t) for i in range(60) for t in (i, i + 1)]
    got = sp.panel_components(frame("u string, t long", rows), "u", "t").collect()
    assert len(got) == 60 and {r.component for r in got} == {"u000"}


def test_kmeans_rounds_against_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.arange(80), "x": rng.normal(size=80), "y": rng.exponential(size=80)})
    df = spark.createDataFrame(pdf)
    got = sp.kmeans_partitions(df, "k", "x", "y", 3, 4, "s", rounds=100).toPandas()
    assert len(got) == 240
    z = np.column_stack([(pdf[c] - pdf[c].mean()) / pdf[c].std() for c in "xy"])
    for _, part in got.groupby("repeat"):
        b = part.sort_values("k").block.to_numpy()
        centres = np.array([z[b == i].mean(0) for i in range(4)])
        assert (((z[:, None] - centres) ** 2).sum(-1).argmin(1) == b).all()  # a fixed point of Lloyd's rounds
    again = sp.kmeans_partitions(df.repartition(5), "k", "x", "y", 3, 4, "s", rounds=100).toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, got.to_numpy()))

def test_partition_signature_ignores_labels(frame):
    a = frame("k long, l long", [(1, 0), (2, 0), (3, 1)])
    b = frame("k long, l long", [(1, 7), (2, 7), (3, 2)])
    c = frame("k long, l long", [(1, 0), (2, 1), (3, 1)])
    sig = [sp.partition_signature(d, "k", "l").first().signature for d in (a, b, c)]
    assert sig[0] == sig[1] != sig[2]


def test_blocked_ridge_against_direct_computation(spark):
    rng = np.random.default_rng(6)
    n = 60
    X = rng.normal(size=(n, 3))
    y = X @ [1.0, -0.5, 0.0] + rng.normal(size=n)
    block = np.arange(n) % 4
    pdf = pd.DataFrame({"k": range(n), "a": X[:, 0], "b": X[:, 1], "c": X[:, 2], "y": y})
    folds = spark.createDataFrame(pd.DataFrame({"repeat": 0, "k": range(n), "block": block}))
    alphas = [0.1, 1.0, 10.0]
    got = sp.ridge_cv(spark.createDataFrame(pdf), "k", "y", ["a", "b", "c"], folds, alphas).toPandas().sort_values("k")
    for f in range(4):
        tr, te = block != f, block == f
        mu, sd = X[tr].mean(0), X[tr].std(0)
        Z, Q, m = (X[tr] - mu) / sd, (X[te] - mu) / sd, y[tr].mean()
        errs = []
        for a in alphas:
            inv = np.linalg.inv(Z.T @ Z + a * np.eye(3))
            h = np.einsum("ij,jk,ik->i", Z, inv, Z) + 1 / tr.sum()
            errs.append(np.mean(((y[tr] - m - Z @ inv @ Z.T @ (y[tr] - m)) / (1 - h)) ** 2))
        a = alphas[int(np.argmin(errs))]
        want = m + Q @ np.linalg.solve(Z.T @ Z + a * np.eye(3), Z.T @ (y[tr] - m))
        assert np.allclose(got[got.fold == f].predicted, want)
        assert (got[got.fold == f].alpha == a).all()


def test_ridge_study_drops_predictors_and_gives_coefficients(spark):
    rng = np.random.default_rng(9)
    n, alphas = 90, [0.5, 5.0]
    X = rng.normal(size=(n, 3)) * [1, 50, 3] + [0, 1000, 7]
    y = X @ [1.0, 0.02, 0.0] + rng.normal(size=n)
    pdf = pd.DataFrame({"k": range(n), "a": X[:, 0], "b": X[:, 1], "c": X[:, 2], "y": y})
    folds = pd.concat([pd.DataFrame({"repeat": r, "k": range(n), "block": rng.integers(0, 3, n)}) for r in range(2)])
    study = sp.ridge_study(spark.createDataFrame(pdf), "k", "y", ["a", "b", "c"], spark.createDataFrame(folds), alphas, drop=True)
    pred, coef = study.predictions.toPandas(), study.coefficients.toPandas()
    assert len(pred) == 2 * n * 4
    for (dropped, repeat, fold), part in pred.fillna({"dropped": ""}).groupby(["dropped", "repeat", "fold"]):
        use = [i for i, x in enumerate("abc") if x != dropped]
        test = part.k.to_numpy()
        tr = np.setdiff1d(np.arange(n), folds[(folds.repeat == repeat) & (folds.block == fold)].k)
        mu, sd = X[tr][:, use].mean(0), X[tr][:, use].std(0)
        z, m = (X[tr][:, use] - mu) / sd, y[tr].mean()
        loo = []
        for a in alphas:
            h = np.einsum("ij,jk,ik->i", z, np.linalg.inv(z.T @ z + a * np.eye(len(use))), z) + 1 / len(tr)
            loo.append(np.mean(((y[tr] - m - z @ np.linalg.solve(z.T @ z + a * np.eye(len(use)), z.T @ (y[tr] - m))) / (1 - h)) ** 2))
        a = alphas[int(np.argmin(loo))]
        beta = np.linalg.solve(z.T @ z + a * np.eye(len(use)), z.T @ (y[tr] - m))
        assert (part.alpha == a).all() and np.allclose(part.predicted, m + (X[test][:, use] - mu) / sd @ beta)
        mine = coef[(coef.dropped.fillna("") == dropped) & (coef["repeat"] == repeat) & (coef.fold == fold)].set_index("predictor").coefficient
        assert np.allclose([mine["abc"[i]] for i in use], beta)
