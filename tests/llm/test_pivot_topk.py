from __future__ import annotations

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from duskline.llm import pivot_topk as V
from duskline.llm.queries import QUERIES, SQL


def run(spark, rows, every=5, k=5, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int").select("vec_id", V.integer_vector(F.col("embedding")).alias("v"))
    return [tuple(r) for r in V.top_k(df, F.col("vec_id") % every == 0, k, **kw).collect()]


def brute(rows, every=5, k=5):
    live = []
    for i, (vid, e, _) in enumerate(rows):
        if vid is not None and e and all(x is not None and math.isfinite(x) for x in e):
            live.append((i, vid, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for i, qid, q in live:
        if qid % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(q, x, strict=False)), vid) for j, vid, x in live if j != i))
            out += [(qid, n + 1, vid, -sc) for n, (sc, vid) in enumerate(s[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in base[i % 60] + (0.01 if i > 100 else 0) * rng.normal(size=8)], 1) for i in range(200)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None], 1), (305, [float("nan")] * 8, 1), (310, [float("inf")] + [0.0] * 7, 1), (None, [1.0] * 8, 1), (315, [0.0] * 8, 1),
             (320, [2.0, -1.0], 1), (10, [0.5] * 8, 1), (10, [0.5] * 8, 1)]
    assert sorted(run(spark, rows)) == brute(rows)
    assert sorted(run(spark, rows, every=50, k=500, pivots=3)) == brute(rows, 50, 500)


def test_few_rows(spark):
    assert run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(1, None, 1)]) == []
    assert sorted(run(spark, [(0, [1.0], 1), (5, [2.0], 1)])) == [(0, 1, 5, 131072), (5, 1, 0, 131072)]


def test_bound_skips_candidates():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.integers(-5, 5, (2000, 8)), rng.integers(900, 1000, (20, 8))]).astype(np.int64)
    p = x[::100].astype(float)
    far = np.sqrt(((x[:, None] - p[None]) ** 2).sum(-1))
    want = sorted(((-int(x[i] @ x[-1]), i) for i in range(len(x) - 1)))[:5]
    for largest, kind in ((1000, np.float64), (1 << 60, np.int64)):
        block = V.Block(np.arange(len(x)), x, far, largest)
        assert block.x.dtype == kind
        assert V.best_of(x[-1], far[-1], block, [len(x) - 1], 5) == [(-s, i) for s, i in want]


def test_ties_go_to_smaller_ids():
    x = np.tile(np.array([[3, 4]], np.int64), (500, 1))
    ids = np.random.default_rng(2).permutation(500)
    assert V.best_of(x[0], np.zeros(1), V.Block(ids, x, np.zeros((500, 1)), 4), [], 5) == [(25, i) for i in range(5)]


def test_query_equals_sql(spark, sf):
    embeddings = duckdb.read_parquet(f"{sf}/embeddings.parquet")  # noqa: F841
    assert sorted(map(tuple, QUERIES["op7_pivot_topk"](spark, sf).collect())) == sorted(duckdb.sql(SQL["op7_pivot_topk"]).fetchall())
