from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from duskline.llm import toxicity_cnn as M
from duskline.llm.common import prepare
from duskline.llm.queries import QUERIES


def corpus(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    rows = []
    for i in range(n):
        words = [rnd.choice(["the", "of", "and"]) if rnd.random() < 0.3 else word() for _ in range(rnd.randint(20, 200))]
        y = int(rnd.random() < 0.3)
        for _ in range(2 * y):
            words[rnd.randrange(len(words))] = rnd.choice(["Nasty,", "vile", "rotten."])
        rows.append((i, " ".join(words), y))
    return rows


def test_learns_words_and_leaves_the_rest(spark, docs_of):
    rows = corpus(700)
    docs, labels = docs_of([r[:2] for r in rows]), spark.createDataFrame([(r[0], r[2]) for r in rows[:450]], "doc_id long, toxic int")
    got = {r["doc_id"]: r["_tx_score"] for r in M.score(docs, M.fit(docs, labels)).collect()}
    wrong = sum((got[i] >= M.CUT) != bool(y) for i, _, y in rows[450:])
    assert wrong <= 5 and all(0 <= s <= 1 for s in got.values())


def test_one_pass_gives_the_scores_of_two(spark, docs_of):
    rows = corpus(300, seed=2)
    docs, labels = docs_of([(*r[:2], "x") for r in rows], "doc_id long, text string, _tx_langx string"), spark.createDataFrame([(r[0], r[2]) for r in rows[:200]], "doc_id long, toxic int")
    one = {r["doc_id"]: r["_tx_score"] for r in M.classify(docs, labels, keep=["doc_id"], rows=60).collect()}
    two = {r["doc_id"]: r["_tx_score"] for r in M.score(docs, M.fit(docs, labels, rows=60)).collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-2  # a dumped model has 16-bit words


def test_maxima_against_loops():
    rng = np.random.default_rng(4)
    model = M.Model(rng)
    texts = ["a b c d e f", "", None, "x", "p q", "a b c d e f g h i"]
    hashes, offs, _ = M.encode(texts)
    model.words += rng.normal(size=model.words.shape)
    best, spot = model.maxima(hashes, offs, where=True)
    for d in range(len(texts)):
        emb = model.embed(hashes[offs[d]:offs[d + 1]])
        row = 0
        for i, w in enumerate(M.WIDTHS):
            outs = [sum(emb[p + j] @ model.filters[row + j] for j in range(w)) for p in range(len(emb) - w + 1)]
            for rank in (0, 1):
                want = [max(0.0, *(sorted({round(float(o[f]), 4) for o in outs})[-1 - rank:][:1] or [0.0])) if len({round(float(o[f]), 4) for o in outs}) > rank else 0.0
                        for f in range(M.FILTERS)]
                k = (rank * len(M.WIDTHS) + i) * M.FILTERS
                assert np.allclose(best[d, k:k + M.FILTERS], want, atol=1e-3)
            row += w
    assert (spot[1] == -1).all()


def test_held_out_rows_are_not_learned(spark, sf):
    rows = QUERIES["op4_toxicity_cnn"](spark, sf).collect()
    assert len(rows) == 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, sf_dir):
    scored = {r["doc_id"]: r for r in QUERIES["op4_toxicity_cnn"](spark, sf_dir).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    held = [(scored[i]["predicted"], y) for i, y in labels if scored[i]["held_out"]]
    caught = np.mean([p for p, y in held if y])
    hurt = np.mean([p for p, y in held if not y])
    print("caught", caught, "clean documents hurt", hurt)
    assert caught > 0.85 and hurt < 0.02  # some toxic labels have lost their words to edits


def test_nulls_empty_and_missing_classes(spark, docs_of):
    prepare(spark)
    docs = docs_of([(1, None, 1), (None, "", 2), (3, "w " * 30000, 3)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, 0), (1, 0), (3, None)], "doc_id long, toxic int")
    model = M.fit(docs, labels)
    assert model is None and {r["_tx_score"] for r in M.score(docs, model).collect()} == {0.0}
    both = spark.createDataFrame([(1, 0), (3, 1), (3, 0)], "doc_id long, toxic int")
    got = M.score(docs, M.fit(docs, both)).collect()
    assert len(got) == 3 and all(0 <= r["_tx_score"] <= 1 for r in got)
    assert M.score(docs_of([]), M.fit(docs_of([]), labels)).count() == 0


def test_thresholds_cover_all_rows_that_were_not_fitted_on(spark, docs_of):
    """A language with too few labels in the training sample still gets its own threshold from the others."""
    rows = [(i, t if i % 10 else t.replace("the", "der").replace("of", "und").replace(" and ", " von "), y) for i, t, y in corpus(1500)]
    docs, labels = docs_of([r[:2] for r in rows]), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    cuts = M.Model.load(M.fit(docs, labels, rows=60)).cuts
    german = 1 + list(M.FUNCTION_WORDS).index("de")
    assert cuts[german] != cuts[0] and cuts[1 + list(M.FUNCTION_WORDS).index("fr")] == cuts[0]


def test_binned_threshold_against_all_cuts():
    rng = np.random.default_rng(8)
    z, y = rng.integers(-300, 300, 500), rng.random(500)
    y = (y < (z + 300) / 600).astype(np.int64)
    bins, at = np.unique(z, return_inverse=True)
    got = M._binned_threshold(bins, np.bincount(at, y), np.bincount(at, 1 - y)) * M.BINS
    gain = lambda c: (z >= c)[y > 0].mean() - 2 * (z >= c)[y == 0].mean()
    assert abs(gain(got) - max(map(gain, bins))) < 1e-12 and bins.min() - M.BINS <= got
