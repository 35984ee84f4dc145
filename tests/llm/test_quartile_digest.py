from __future__ import annotations

import hashlib
import random

import numpy as np

from duskline.llm import quartile_digest as Q


def brute(rows):
    order = sorted(rows, key=lambda r: (-(Q._LOWEST if r[0] is None else r[0]), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        e = (t[:len(t) - k] + after[:k]).encode()
        p = [Q.digests([x]) for x in (t.encode(), e, after.encode())]
        out.append((d, len(t), hashlib.sha256(e).hexdigest(), Q.as_text(*p[0])[0], Q.as_text(*p[1])[0], float(Q.likeness(p[0], p[1])[0]), float(Q.likeness(p[0], p[2])[0])))
    return sorted(out, key=str)


def test_chain_against_brute_force(docs_of):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgé ßü\n") for _ in range(n))
    rows = [(i * 3, text(rnd.choice([0, 1, 2, 3, 10, 100, 2000]))) for i in range(150)] + [(None, "last"), (12, "tie"), (12, "tie"), (15, None), (449, "x" * 70000), (449, "a")]
    got = sorted(map(tuple, Q.chain(docs_of(rows).repartition(5)).collect()), key=str)
    assert got == brute(rows)


def test_small_tables(docs_of):
    assert Q.chain(docs_of([])).count() == 0
    assert sorted(map(tuple, Q.chain(docs_of([(5, "lonely text")])).collect())) == brute([(5, "lonely text")])
    assert sorted(map(tuple, Q.chain(docs_of([(None, None), (None, None)])).collect()), key=str) == brute([(None, None)] * 2)
    wide = docs_of([(1, "a", 2, True, "p"), (2, "b", 1, False, "q")], "doc_id long, text string, part int, ctx boolean, _qd_x string")
    assert Q.chain(wide).count() == 2


def test_counters_and_likeness():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 120, n, dtype=np.uint8)) for n in (0, 2, 3, 4, 900)]
    counts = Q.counters(texts)
    assert counts.sum(axis=1).tolist() == [max(0, len(t) - 2) + max(0, len(t) - 3) for t in texts]
    for t, row in zip(texts, counts, strict=True):
        assert (Q.counters([t])[0] == row).all()
    d = Q.digests(texts)
    assert (Q.likeness(d, d) == 1).all()
    back = Q.parse(Q.as_text(*d))
    assert (back[0] == d[0]).all() and (back[1] == d[1]).all()


def test_edited_is_nearer_than_another(spark):
    rows = Q.chain(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    long = [r for r in rows if r["n_chars"] >= 300]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9
