from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from duskline.llm import divergence as M


def plain(rows, least, top=10):
    """(lang, source, text) rows by the definition."""
    rows = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [(g, s, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(low))) for g, s, t in rows]
    out = []
    for lang in {g for g, _, _ in rows}:
        docs = Counter(w for g, _, ws in words if g == lang for w in set(ws))
        kept = [w for w, k in docs.items() if k >= least]
        n = {s: Counter() for g, s, _ in rows if g == lang}
        for g, s, ws in words:
            if g == lang:
                n[s].update(w for w in ws if w in set(kept))
        whole = sum(n.values(), Counter())

        def share(c, w, v=len(kept)):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v)

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        for s in n:
            pair = sorted(((-sum(far(share(n[s], w), share(n[o], w)) for w in kept), o.encode(), o) for o in n if o != s))
            term = sorted((-far(share(n[s], w), share(whole, w)), w.encode(), w) for w in kept if n[s][w] and share(n[s], w) > share(whole, w))[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, i, -v, k + 1) for k, (v, _, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "cells"), [(1, M.CELLS), (2, 30), (3, 7)])
def test_against_the_definition(docs_of, monkeypatch, seed, cells):
    monkeypatch.setattr(M, "CELLS", cells)
    monkeypatch.setattr(M, "PAIRS", 2)
    rnd = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "zebra's", "x1y", "ß", "中", "Ω", *[f"w{chr(97 + i)}" for i in range(12)]]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["s", "t", None, "u", "é"]), rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randint(1, 30)))])) for _ in range(150)]
    rows += [("fr", "only", "one two"), ("it", "a", "x"), ("it", "b", None)] + rows[:5]
    docs = docs_of([(1, *r, 5) for r in rows], "n long, lang string, source string, text string, docs int").repartition(4)
    got = sorted(tuple(r) for r in M.audit(docs, least=4).collect())
    assert got == plain(rows, 4)


def test_no_rows(docs_of):
    assert M.audit(docs_of([], "lang string, source string, text string")).count() == 0


def test_trees_share_and_price_once():
    counts = np.zeros((3, 1000), np.int64)
    counts[1, 5], counts[2, 5] = 7, 7
    t = M.Trees(counts)
    assert t.roots[1] == t.roots[2] != t.roots[0]
    which, x, y, times = t.meet(np.array([0, 1]), np.array([1, 2]))
    assert sorted(zip(which.tolist(), x.tolist(), y.tolist(), times.tolist(), strict=True)) == [(0, 0, 0, 999), (0, 0, 7, 1), (1, 0, 0, 999), (1, 7, 7, 1)]


def test_shares_are_exact():
    rnd = random.Random(4)
    for _ in range(2000):
        size = rnd.randint(2, 2 * 10**14)
        c = rnd.randint(0, size - 2)
        assert int(M.shares(np.array([c]), np.int64(size))[0]) == 1 + 10**9 * (c + 2) // size
