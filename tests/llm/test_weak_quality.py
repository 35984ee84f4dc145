from __future__ import annotations

import numpy as np

from duskline.llm import weak_quality as Q
from duskline.llm.queries import QUERIES


def test_em_finds_accuracies():
    rng = np.random.default_rng(6)
    truth, right = rng.random(20000) < 0.7, np.array([0.9, 0.85, 0.8, 0.75, 0.7, 0.6])
    v = np.where(rng.random((20000, 6)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    v[rng.random(v.shape) < 0.2] = 0
    codes, counts = np.unique(((v + 1) * 3 ** np.arange(6)).sum(axis=1), return_counts=True)
    got, good = Q.estimate(codes, counts.astype(float))
    assert np.abs(got - right).max() < 0.05 and good.min() < 0.1 and good.max() > 0.95


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    kept = {r["doc_id"]: r["keep"] for r in QUERIES["op9_weak_quality"](spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good, bad = np.mean([kept[i] for i, q in labels if q == 1]), np.mean([kept[i] for i, q in labels if q == 0])
    print("good kept", good, "bad kept", bad)
    assert good > 0.95 and bad < 0.45


def test_edges(docs_of):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 40000, 3)]
    got = Q.quality(docs_of(rows, "doc_id long, text string, good int")).collect()
    assert len(got) == 4 and all(0 <= r["_wq_score"] <= 1 for r in got)
    assert Q.quality(docs_of([])).count() == 0
