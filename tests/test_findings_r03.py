from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from duskline.operators import neighbours as nb
from duskline.plans import ctes as c
from duskline.plans.catalog import REGISTRY
from duskline.sources import mapping as m
from duskline.sources.tables import Tables


@pytest.fixture(scope="module")
def tied_cells(tmp_path_factory):
    """Parts with 32 order lines each: their mean price often lies on a half of the sixth digit."""
    out, con = tmp_path_factory.mktemp("tied"), duckdb.connect()
    big = "/root/testdata/sf0.1"
    con.execute(f"CREATE TABLE lineitem AS SELECT * FROM '{big}/lineitem.parquet' WHERE l_partkey IN (SELECT l_partkey FROM '{big}/lineitem.parquet' GROUP BY 1 HAVING count(*) = 32)")
    con.execute(f"CREATE TABLE part AS SELECT * FROM '{big}/part.parquet' WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{out}/{t}.parquet'")
    return str(out), con


def test_heat_on_a_half_is_rounded_up(spark, tied_cells):
    sf, con = tied_cells
    t = Tables(spark, sf)
    got = {r.cell_id: r.heat_gp for r in m.screen_cells(t, ties_up=True).collect()}
    # prices are cents: the mean of 32 in whole millionths, halves up, in integers
    want = con.execute("SELECT l_partkey, ((sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 10000 * 2 + 32) // 64)::BIGINT FROM lineitem GROUP BY 1").fetchall()
    assert got == {k: v / 1e6 for k, v in want}
    assert got == dict(con.execute(c.with_(c.SCREEN_TIES_UP) + " SELECT cell_id, heat_gp FROM cells").fetchall())


@pytest.mark.parametrize("name", ["rank_component_scores", "layer_sensitivity", "duplicate_decisions"])
def test_screens_do_not_follow_the_order_of_the_lines(spark, tied_cells, tmp_path, name):
    sf, con = tied_cells
    con.execute(f"COPY part TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (FROM lineitem ORDER BY md5(l_orderkey::VARCHAR || l_linenumber)) TO '{tmp_path}/lineitem.parquet'")
    q = REGISTRY[name]
    want = sorted(tuple(r) for r in q.run(spark, sf).collect())
    assert sorted(tuple(r) for r in q.run(spark, str(tmp_path)).collect()) == want
    assert sorted(con.execute(q.oracle()).fetchall()) == want


def test_idw_meets_bounded_blocks(spark, monkeypatch):
    """What one task meets is a block of cells and a block of stations, and their number follows from the blocks, not from small tiles."""
    import numpy as np
    import pandas as pd

    from duskline.operators import spatial as sp

    rng = np.random.default_rng(3)
    cells = pd.DataFrame({"q": range(900), "a": rng.random(900), "b": rng.random(900)})
    st = pd.DataFrame({"s": range(700), "x": rng.random(700), "y": rng.random(700), "v": rng.random(700)})
    st.loc[[5, 9], ["x", "y"]] = cells.loc[3, ["a", "b"]].to_numpy(float)
    monkeypatch.setattr(sp, "STATION_BLOCK", 150)
    out = sp.idw(spark.createDataFrame(cells), "q", ("a", "b"), spark.createDataFrame(st), "s", ("x", "y"), "v", per_tile=400)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
    d2 = (cells.a.to_numpy()[:, None] - st.x.to_numpy()) ** 2 + (cells.b.to_numpy()[:, None] - st.y.to_numpy()) ** 2
    want = (st.v.to_numpy() / np.maximum(d2, 1e-18)).sum(1) / (1 / np.maximum(d2, 1e-18)).sum(1)
    want[3] = st.v[5]
    got = out.toPandas().sort_values("q").idw.to_numpy()
    assert np.allclose(got, want, rtol=1e-9, atol=0)


def test_neighbours_of_a_crowded_node_are_exact_and_rows_carry_no_lists(spark, monkeypatch):
    """Asks of one node are cut into crowds; no row of asks carries the boxes or points of a node."""
    import numpy as np
    import pandas as pd

    from duskline.operators import neighbours as nb

    rng = np.random.default_rng(5)
    s = pd.DataFrame({"sid": np.arange(600), "x": rng.normal(size=600).round(1), "y": rng.normal(size=600).round(1)})
    q = pd.DataFrame({"q": np.arange(300), "a": rng.normal(size=300).round(1), "b": rng.normal(size=300).round(1)})
    q.loc[:199, ["a", "b"]] = [0.1, 0.2]
    monkeypatch.setattr(nb, "CROWD", 16)
    trees = nb.forest(spark.createDataFrame(s), "sid", ("x", "y"), per_tile=8, copies=3)
    out = nb.nearest_lists(spark.createDataFrame(q), "q", ("a", "b"), trees, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "transform(" not in plan
    for r in out.collect():
        me = q.iloc[r.q]
        want = sorted(zip(np.round((s.x - me.a) ** 2 + (s.y - me.b) ** 2, 9), s.sid))[:3]
        assert [(b.d2, b.id) for b in r.best] == want


def _descent(df, p, asks):
    """Leaves a search of 30 earlier neighbours visits, per ask, and whether the lists are those of all pairs."""
    made, kept = [], nb.settled
    nb.settled = lambda d: made.append(kept(d)) or made[-1]
    try:
        got = nb.nearest_lists(df.sparkSession.createDataFrame(asks), "k", ("x", "y"), nb.forest(df, "k", ("x", "y"), copies=30, prefer="o"), 30, before="o").toPandas()
    finally:
        nb.settled = kept
    for r in got.itertuples():
        ask = p.loc[r.k]
        d = ((p.x - ask.x) ** 2 + (p.y - ask.y) ** 2)[p.o < ask.o]
        assert np.allclose([b["d2"] for b in r.best], sorted(d)[:30], atol=1e-8)
    return made[-1].count() / len(asks) + 1


def test_a_search_visits_few_leaves(spark):
    """Runs of the curve had wide boxes, and any leaf that held the place came first: on check_s a fold of 34 leaves was searched in 16."""
    rng = np.random.default_rng(4)
    n = 6000
    p = pd.DataFrame({"k": np.arange(n), "o": rng.permutation(n), "x": rng.normal(size=n), "y": rng.normal(size=n)})
    assert _descent(spark.createDataFrame(p), p, p[p.o >= n // 2].sample(300, random_state=1)) < 6


def test_places_along_the_curve_are_neighbours():
    side = 1 << 6
    x, y = (a.ravel().astype(np.int64) for a in np.meshgrid(np.arange(side), np.arange(side)))
    order = nb._along(x, y).argsort()
    assert (np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) == 1).all()
