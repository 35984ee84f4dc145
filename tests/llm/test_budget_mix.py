from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from duskline.llm import budget_mix as M


def targets(sizes):
    """sizes: of each source in order; excess shared again, round by round."""
    want = {s: 0.0 for s in range(len(sizes))}
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
    open_, left = set(want), 1.5 * sum(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total >= 2 * sizes[s]}
        if not full:
            for s in open_:
                want[s] = left * weights[s] / total
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
        left -= sum(want[s] for s in full)
        open_ -= full
    return want


def test_fit_against_all_subsets():
    rnd = random.Random(3)
    for _ in range(60):
        items = [rnd.randint(1, 9) for _ in range(rnd.randint(1, 7))]
        sizes, counts = np.unique(np.array(items), return_counts=True)
        budget = rnd.randint(0, sum(items))
        best = max(t for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (t := sum(c)) <= budget)
        take = M.fit(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        got = int((take * sizes).sum())
        assert got <= budget and budget - got <= max(items) and got >= best - max(items)


def test_large_budget_is_met_exactly():
    sizes, counts = np.arange(1, 3000), np.full(2999, 7)
    total = int((sizes * counts).sum())
    for budget in (total // 3, total - 1, 1, 40000):
        take = M.fit(sizes, counts, budget)
        assert int((take * sizes).sum()) == budget and (take <= counts).all()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(docs_of, seed):
    rnd = random.Random(seed)
    names = ["b", "a", "é", None, "", "z"][: rnd.randint(2, 6)]
    rows = [(i, rnd.choice(names), rnd.choice([None, 0, 1, 5, 17, 100])) for i in range(400)] + [(7, names[0], 3)] * 5
    schema = "doc_id long, source string, size long"
    got = M.mix(docs_of(rows, schema), "size").collect()
    assert len(got) == len(rows)
    order = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    totals = [sum(n or 0 for _, s, n in rows if s == o) for o in order]
    want, taken = targets(totals), defaultdict(int)
    for r in got:
        s = order.index(r["source"])
        assert r["_bm_source_size"] == totals[s] and abs(r["_bm_target"] - want[s]) < 1e-6 and 0 <= r["_bm_copies"] <= 2
        taken[s] += r["_bm_copies"] * (r["size"] or 0)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 100
    again = M.mix(docs_of(rows[::-1], schema).repartition(3), "size").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_and_zero(docs_of):
    schema = "doc_id long, source string, size long, n int, target string"
    assert M.mix(docs_of([], schema), "size").count() == 0
    got = M.mix(docs_of([(1, "a", 0, 1, "t"), (2, None, None, 2, "u")], schema), "size").collect()
    assert len(got) == 2 and all(r["_bm_target"] == 0 for r in got)
