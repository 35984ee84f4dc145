from __future__ import annotations

import random

import numpy as np

from duskline.llm import simhash_golay as S
from duskline.llm.graph import components


def brute(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_golay_is_perfect():
    near = S._nearest()
    assert len(np.unique(near)) == 4096 and (np.bincount(near) == 2048).all()


def test_no_link_is_lost(spark):
    rnd = random.Random(1)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    for f in fps[:200]:
        g = f
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            g ^= 1 << b
        fps.append(g)
    fps = sorted({np.uint64(f).astype(np.int64).item() for f in fps})
    got = {(r.u, r.v) for r in S.links(spark.createDataFrame([(f,) for f in fps], "_sg_fp long")).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_groups_against_brute_force(docs_of):
    rnd = random.Random(2)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "eta", "theta"]
    base = [[rnd.choice(words) for _ in range(rnd.randint(0, 120))] for _ in range(25)]
    texts = []
    for b in base * 4:
        b = list(b)
        if b and rnd.random() < 0.7:
            b[rnd.randrange(len(b))] = "changed"
        texts.append("\t".join(b) if rnd.random() < 0.5 else " ".join(b).upper())
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "one two"), (503, "one")]
    got = sorted((r["doc_id"], r["_sg_fp"] & (2**64 - 1), r["_sg_group"]) for r in S.near_groups(docs_of(rows)).collect())
    fps = [S.fingerprint((t or "").encode()) for _, t in rows]
    root = brute(fps)
    ids = [i for i, _ in rows]
    want = sorted((i, f, min(ids[k] for k in range(len(rows)) if root[k] == root[n])) for n, (i, f) in enumerate(zip(ids, fps, strict=True)))
    assert got == want
    firsts = [r for r in S.near_groups(docs_of(rows)).collect() if r["_sg_first"]]
    assert len(firsts) == len(set(root)) and {r["doc_id"] for r in firsts} == {w[2] for w in want}


def test_null_ids_other_columns_empty(docs_of):
    schema = "doc_id long, text string, u long, _x string"
    got = S.near_groups(docs_of([(None, "a b c d", 1, "x"), (None, "a b c d", 2, None), (7, "q r s t u", 3, "z")], schema)).collect()
    assert sorted(r["u"] for r in got) == [1, 2, 3] and sum(r["_sg_first"] for r in got) == 2
    assert S.near_groups(docs_of([], schema)).count() == 0


def test_long_chain(spark):
    edges = [(i + 1, i) for i in range(400)] + [(1000 + i, 1000) for i in range(1, 50)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.u: r.v for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 401)}, **{1000 + i: 1000 for i in range(1, 50)}}
