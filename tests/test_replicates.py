"""Statistics on the replicate axis against copying rows."""

from __future__ import annotations

import numpy as np
import pandas as pd

from duskline.operators import replicates as rp
from duskline.operators import resample as rs


def copied(rows, w):
    return rows.loc[np.repeat(rows.index, w.astype(int))]


def test_rank_and_partial_correlations_of_every_replicate():
    rng = np.random.default_rng(1)
    n, reps = 60, 25
    rows = pd.DataFrame({"x": rng.integers(0, 12, n) / 4, "y": rng.normal(size=n), "c": rng.integers(0, 2, n) * 1.0, "s": rng.normal(size=n), "dead": 0.0})
    w = rng.integers(0, 3, (n, reps)).astype(float)
    w[:, 3] = 0
    w[:5, 3] = 1
    got = rp.rank_correlation("x", "y", ["c", "s", "dead"], raw=["c", "s", "dead"], min_n=8)(rows, w)
    plain = rp.rank_correlation("x", "y")(rows, w)
    slopes = rp.slope("x", "y")(rows, w)
    for r in range(reps):
        d = copied(rows, w[:, r])
        a, b = d.x.rank(), d.y.rank()
        assert np.isclose(plain[r], np.corrcoef(a, b)[0, 1])
        assert np.isclose(slopes[r], np.polyfit(d.x, d.y, 1)[0])
        if r == 3:
            assert np.isnan(got[r])
            continue
        z = np.column_stack([np.ones(len(d)), d.c, d.s])
        ra, rb = (v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (a, b))
        assert np.isclose(got[r], np.corrcoef(ra, rb)[0, 1])
    few = rp.rank_correlation("x", "y", least_x=6)(rows, np.eye(n)[:, :7] + np.eye(n)[:, 7:14])
    assert np.isnan(few).all()


def test_block_weights_equal_drawn_days(spark):
    cal = spark.createDataFrame([(y, d) for y, n in ((2000, 30), (2003, 9)) for d in range(n)], "year long, day_index long")
    rows = pd.DataFrame([(y, d) for y, n in ((2000, 30), (2003, 9)) for d in range(n)], columns=["year", "day_index"])
    starts = rs.block_starts(cal, 12, "s", 7).toPandas()
    want = rs.block_draws(cal, 12, "s", 7).toPandas().pivot_table(index=["year", "day_index"], columns="replicate", values="times", fill_value=0)
    want = want.reindex(pd.MultiIndex.from_frame(rows), fill_value=0)
    got = rp.block_weights(starts[starts.replicate >= 4], rows, np.arange(4, 12))
    assert (got == want.to_numpy()[:, 4:]).all() and (got[:30].sum(0) == 30).all() and (got[30:].sum(0) == 9).all()


def test_jobs_cover_scopes_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"g": np.repeat(["a", "b"], 40), "cl": np.tile(np.arange(8), 10), "x": rng.normal(size=80), "y": rng.normal(size=80)})
    df = spark.createDataFrame(p)
    draws = rs.cluster_draws(df, "cl", 70, "s", ["g"])
    est = rp.apply(df, draws, 70, rp.rank_correlation("x", "y"), ["g"], lambda d, r, at: rp.key_weights(d, r, at, ["cl"]), chunk=32).toPandas()
    assert len(est) == 140
    times = draws.toPandas().set_index(["g", "replicate", "cl"]).times
    for g, r, e in est.itertuples(index=False):
        mine = p[p.g == g]
        d = copied(mine, np.array([times.get((g, r, c), 0) for c in mine.cl]))
        assert np.isclose(e, np.corrcoef(d.x.rank(), d.y.rank())[0, 1])


def test_block_rank_correlations_equal_copies(spark):
    rng = np.random.default_rng(6)
    n = 150
    p = pd.DataFrame({"b": rng.integers(0, 5, n), "x": rng.integers(0, 30, n) / 3, "y": rng.normal(size=n), "e": rng.normal(size=n), "q": rng.normal(size=n)})
    df = spark.createDataFrame(p)
    got = rs.block_rank_correlations(df, "x", "y", "b", 40, "s", ["e", "q"], pieces=3).toPandas().set_index("replicate")
    times = rs.cluster_draws(df, "b", 40, "s").toPandas().set_index(["replicate", "b"]).times
    for r in range(-1, 40):
        d = copied(p, np.array([1 if r < 0 else times.get((r, b), 0) for b in p.b]))
        a, b = d.x.rank(), d.y.rank()
        z = np.column_stack([np.ones(len(d)), d.e, d.q])
        ra, rb = (v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (a, b))
        assert np.isclose(got.rho[r], np.corrcoef(a, b)[0, 1]) and np.isclose(got.partial[r], np.corrcoef(ra, rb)[0, 1]) and got.n[r] == len(d)
