from __future__ import annotations

import random
from itertools import accumulate

import duckdb
import numpy as np
import pandas as pd
import pytest

from duskline.operators import multiverse as mv
from duskline.operators import selection as sl
from duskline.plans import screens
from duskline.sources import mapping as m
from duskline.sources.tables import Tables


def _rounded(values) -> float:
    *_, total = accumulate(values)
    return round(total / len(values) + m.TIES_UP, 6)


def test_heat_does_not_follow_the_order_of_the_lines(spark, tmp_path):
    """The mean of this part's ratios lies 2e-12 from where its rounding turns; sums in some orders cross that."""
    con = duckdb.connect()
    lines = con.execute("SELECT * FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_partkey = 4204").df()
    con.execute(f"COPY (FROM '/root/testdata/sf0.1/part.parquet' WHERE p_partkey = 4204) TO '{tmp_path}/part.parquet'")
    order, seen = list(range(len(lines))) * 60, {}
    rng = random.Random(4)
    while len(seen) < 2:
        rng.shuffle(order)
        many = lines.iloc[order]
        seen.setdefault(_rounded((many.l_extendedprice / many.l_quantity).tolist()), many)
    for many in seen.values():
        con.execute(f"COPY many TO '{tmp_path}/lineitem.parquet'")
        assert m.screen_cells(Tables(spark, str(tmp_path)), ties_up=True).first()["heat_idw"] == 3611.244697


def test_cells_are_rows_and_decisions_an_axis(spark):
    sel = screens.selections(Tables(spark, "/root/testdata/sf0.001"))
    assert sel.cells.count() == m.screen_cells(Tables(spark, "/root/testdata/sf0.001")).count() and len(sel.names) == 54


@pytest.mark.parametrize("tied", [False, True])
def test_cuts_are_exact(spark, tied):
    """Scores that share bins, tie at a cut, are all the same or missing."""
    rng = np.random.default_rng(5)
    n, shares = 700, (0.05, 0.13, 0.5)
    s = np.stack([rng.random(n) * 100, 40 + rng.random(n) * 1e-7, rng.integers(0, 4, n) * 25.0, np.full(n, 12.5)], axis=1)
    if tied:
        s[:, :2] = np.round(s[:, :2] / 30) * 30
    s[::11, 0] = np.nan
    keys = rng.permutation(n) - 50
    names = [("gp", "baseline", "qmargin"), ("gp", "equal_components", "qmargin"), ("idw", "baseline", "lower"), ("idw", "leave_out_heat", "lower")]
    rows = pd.DataFrame({"cell": keys, "people": rng.integers(0, 50, n) * 1.0, "scores": [[None if np.isnan(v) else float(v) for v in r] for r in s]})
    got = mv.multiverse(spark.createDataFrame(rows, "cell long, people double, scores array<double>"), "cell", names, shares)
    want = np.zeros((n, 4, 3), bool)
    for d in range(4):
        order = sorted((i for i in range(n) if not np.isnan(s[i, d])), key=lambda i, d=d: (-s[i, d], keys[i]))
        for j, share in enumerate(shares):
            want[order[:int(np.ceil(round(share * len(order), 9)))], d, j] = True
    at = {k: i for i, k in enumerate(keys)}
    freq = mv.frequencies(got, {"all": np.arange(4), "first": np.array([0])}).collect()
    assert len(freq) == n * 3
    for r in freq:
        w = want[at[r["cell"]], :, shares.index(r["share"])]
        assert (r["baseline"], r["all"], r["first"]) == (w[0], w.mean(), float(w[0]))
    table = {(*[r[c] for c in sl.DECISION], r["share"]): r for r in mv.decision_table(got, "people").collect()}
    for d, name in enumerate(names):
        for j, share in enumerate(shares):
            r, w, b = table[(*name, share)], want[:, d, j], want[:, 0, j]
            assert (r["n_selected"], r["overlap"], r["jaccard"], r["selected_population"]) == (w.sum(), (w & b).sum(), (w & b).sum() / (w | b).sum(), rows.people[w].sum())


@pytest.mark.parametrize("way", ["fingerprints", "sets"])
def test_no_side_that_a_step_multiplies_is_broadcast(spark, way):
    """The looked-up keys are some 80 for a fingerprint, but Spark sizes them as one."""
    from pyspark.sql import functions as F

    from duskline.llm import shingle_join, simhash_golay
    from duskline.session import settled

    if way == "fingerprints":
        out = simhash_golay.links(settled(spark.range(3000).select(F.xxhash64("id").alias("_sg_fp"))))
    else:
        sets = settled(spark.range(300).select(F.col("id").alias("s"), F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.xxhash64(F.col("id") % 50, i)).alias("held")))
        out = shingle_join._links(settled(spark.range(299).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))), sets)
    rows = out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert way == "fingerprints" or not rows


def test_folds_leave_nothing_but_their_predictions(spark, monkeypatch):
    """A round's neighbour lists are deleted before the next one, and rounds change nothing."""
    from duskline.operators import process
    from duskline.session import settled_scope

    rng = np.random.default_rng(8)
    st = spark.createDataFrame(pd.DataFrame({"s": range(24), "x": rng.random(24), "y": rng.random(24), "v": rng.random(24), "e": np.full(24, 0.1)}))
    folds = spark.createDataFrame([(1, i, i % 2) for i in range(24)], "repeat long, s long, block long")
    found = []
    for at_round in (1 << 20, 1):
        monkeypatch.setattr(process, "AT_ROUND", at_round)
        with settled_scope() as made:
            cv = process.cross_validation(st, "s", ("x", "y"), "v", "e", folds, [(0.5, 1.0, 0.3), (0.1, 1.0, 0.3)], near=5)
            found.append((sorted(map(tuple, cv.collect())), len(made)))
    (one, few), (two, more) = found
    assert one == two and len(one) == 24 and all(r[4] is not None for r in one)
    assert (few, more) == (3, 4)  # two tables of labelled stations, and predictions of each round
