"""Ranks, quantiles, top shares and tiers against brute force, with hot values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskline.operators import ranks, selection, uncertain


def test_average_and_percentile_ranks(frame):
    df = frame("k long, v double", [(1, 1.0), (2, 1.0), (3, 3.0), (4, None)])
    r = ranks.pct_rank(ranks.spread_rank(df, "v", (), "rk"), "v", (), "p").orderBy("k").collect()
    assert [x.rk for x in r] == [1.5, 1.5, 3.0, None]
    assert [x.p for x in r] == [0.5, 0.5, 1.0, None]
    rev = ranks.pct_rank(df, "v", (), "p", reverse=True).orderBy("k").collect()
    assert [x.p for x in rev] == [0.5, 0.5, 0.0, None]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"k": np.arange(n), "g": np.where(rng.random(n) < 0.8, "hot", rng.choice(list("ab"), n)),
                        "v": np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(5, 4, n), 2))})
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def test_ranks_with_hot_group_and_hot_value(skewed):
    pdf, df = skewed
    got = ranks.spread_rank(df, "v", "g", "rk", pieces=5).toPandas().set_index("k").sort_index()
    assert np.allclose(got.rk, pdf.groupby("g").v.rank())
    assert len(got) == len(pdf)


def test_exact_quantiles(skewed):
    pdf, df = skewed
    ps = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    got = ranks.exact_quantiles(df, "g", "v", ps, pieces=7).toPandas().set_index(["g", "p"])["quantile"].sort_index()
    want = pdf.groupby("g").v.quantile(ps)
    assert np.allclose(got.to_numpy(), want.sort_index().to_numpy())


@pytest.mark.parametrize("by", [(), ("g",)])
def test_top_shares_are_exact_with_ties(skewed, by):
    pdf, df = skewed
    shares = [0.05, 0.3, 0.5]
    got = ranks.top_shares(df, "v", shares, "k", by, pieces=4).toPandas()
    assert len(got) == len(pdf)
    for i, s in enumerate(shares):
        sel = got[got.selected.map(lambda a, i=i: a[i])]
        groups = got.groupby(list(by)) if by else [("all", got)]
        for name, g in groups:
            want = g.sort_values(["v", "k"], ascending=[False, True]).head(math.ceil(s * len(g))).k
            mine = sel if not by else sel[sel.g == (name[0] if isinstance(name, tuple) else name)]
            assert set(mine.k) == set(want)


def test_top_share_first_rows_win_ties(frame):
    df = frame("k long, s double", [(1, 5.0), (2, 5.0), (3, 5.0), (4, 1.0)])
    got = ranks.top_share(df, "s", 0.5, "k").where("selected").orderBy("k").collect()
    assert [r.k for r in got] == [1, 2]


def test_tiers_expand_ties(frame):
    df = frame("k long, s double", [(i, float(min(i, 8))) for i in range(10)])
    r = {x.k: x.tier for x in ranks.tiers(df, "s").collect()}
    assert [r[8], r[9]] == ["highest_priority"] * 2 and r[0] == "baseline_monitoring"


def test_qcut_matches_pandas(skewed):
    pdf, df = skewed
    x = pdf.drop_duplicates("v")
    got = ranks.qcut(df.dropDuplicates(["v"]), "v", 4).groupBy("bin").count().orderBy("bin").toPandas()
    want = pd.qcut(x.v, 4, labels=False).value_counts().sort_index()
    assert got["count"].tolist() == want.tolist()


def test_weights_sum_to_one_and_reject_bad_ones():
    w = selection.weight_scenarios()
    assert len(w) == 9
    for v in w.values():
        assert abs(sum(v) - 1) < 1e-12 and min(v) >= 0
    assert w["leave_out_heat"] == (0.0, 1 / 3, 1 / 3, 1 / 3)
    with pytest.raises(ValueError):
        selection.weight_scenarios({"bad": (-1.0, 1.0, 1.0, 1.0)})


def test_multiverse_counts_are_exact(spark):
    rng = np.random.default_rng(0)
    n = 57
    pdf = pd.DataFrame({"cell": np.arange(n), **{c: rng.random(n) for c in ("gp", "idw", "q", "l", "a", "cooling", "intensity")}})
    r = spark.createDataFrame(pdf)
    scored = selection.decisions(r, "cell", {"gp": "gp", "idw": "idw"}, {"qmargin": "q", "lower": "l", "all_residents": "a"})
    sel = selection.multiverse(scored, "cell")
    tab = selection.decision_table(sel, r, "cell", "q").toPandas()
    assert len(tab) == 2 * 9 * 3 * 4
    assert (tab.n_selected == tab.share.map(lambda s: math.ceil(round(s * n, 9)))).all()
    base = tab[(tab.heat_field == "gp") & (tab.weight_scenario == "baseline") & (tab.population_lens == "qmargin")]
    assert (base.jaccard == 1).all()
    freq = selection.selection_frequency(sel, "cell").toPandas()
    assert np.allclose(freq.groupby("share").freq_all.sum(), [math.ceil(s * n) for s in (0.05, 0.1, 0.15, 0.2)])


def test_monte_carlo_frequencies_sum_to_selected(spark):
    n = 40
    pdf = pd.DataFrame({"cell": np.arange(n), "mu": np.linspace(0, 1, n), "sd": 0.2, "elderly": 0.5, "cooling": 0.5, "intensity": 0.5})
    f = uncertain.selection_frequency(spark.createDataFrame(pdf), "cell", [uncertain.Outcome("mu", "sd", "t")], (0.4, 0.3, 0.2, 0.1), (0.1, 0.25), 15).toPandas()
    assert np.allclose(f.groupby("share").frequency.sum(), [4, 10])
    again = uncertain.selection_frequency(spark.createDataFrame(pdf).repartition(5), "cell", [uncertain.Outcome("mu", "sd", "t")], (0.4, 0.3, 0.2, 0.1), (0.1, 0.25), 15).toPandas()
    key = ["cell", "share"]
    assert f.sort_values(key).frequency.tolist() == again.sort_values(key).frequency.tolist()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1.0, 1.5, 2.0, -3.25]), min_size=1, max_size=25))
def test_rank_property(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v double")
    got = [r.rk for r in ranks.spread_rank(df, "v", (), "rk", pieces=3).orderBy("k").collect()]
    assert got == pd.Series(values).rank().tolist()


def test_weighted_cumulative_counts(frame):
    df = frame("v double, w long", [(1.0, 2), (1.0, 1), (2.0, 5), (4.0, 0)])
    r = ranks.cumulative_counts(df, (), "v", 2, weight="w").orderBy("value").collect()
    assert [(x.value, x.n, x.below, x.total) for x in r] == [(1.0, 3, 0, 8), (2.0, 5, 3, 8), (4.0, 0, 8, 8)]
    assert df.select(F.sum("w")).first()[0] == 8
