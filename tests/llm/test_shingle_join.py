from __future__ import annotations

import random

import corpus_pipeline
import numpy as np

from duskline.llm import shingle_join as S


def plain_set(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_groups(texts):
    """Root (first index) of each text: single links at Jaccard 0.8 or more, by comparing all pairs."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rnd):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for size in (1, 3, 5, 9, 30, 60, 60, 120, 250):
        for _ in range(4):
            base = [rnd.choice(words) for _ in range(size)]
            texts.append(base)
            for _ in range(5):  # chains: the next is edited from any earlier one
                base = list(rnd.choice(texts[-3:])) if rnd.random() < 0.5 else list(base)
                for _ in range(rnd.randint(0, 1 + size // 60)):
                    base[rnd.randrange(len(base))] = rnd.choice(words)
                texts.append(base)
    return ["\t".join(t).upper() if rnd.random() < 0.3 else " ".join(t) for t in texts]


def test_groups_against_brute_force(docs_of):
    texts = [*edited(random.Random(4)), None, "", " \n"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = sorted((r["doc_id"], r["_sj_group"]) for r in S.near_groups(docs_of(rows)).collect())
    want = sorted((i, plain_groups([t for _, t in rows])[n]) for n, (i, _) in enumerate(rows))
    assert got == want and len({g for _, g in want}) > 30


def test_stage_drops_documents_with_a_changed_word(spark, docs_of):
    rnd = random.Random(5)
    rows = []
    for i in range(20):
        words = [f"v{rnd.randrange(3000)}" for _ in range(60)]
        rows.append((2 * i, " ".join(words)))
        words[30] = "changed"
        rows.append((2 * i + 1, " ".join(words)))  # 51 of 61 shingles are shared
    left = corpus_pipeline.near_duplicates(spark, docs_of(rows), "").collect()
    assert {r["doc_id"] for r in left} == {2 * i for i in range(20)}


def test_only_verified_pairs_link(spark):
    """A bucket in common is not a link; sets that miss the smallest of their bucket still meet each other."""
    sets = spark.createDataFrame([(1, list(range(10))), (2, list(range(5, 15))), (3, list(range(5, 16)))], "s long, held array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "u long, v long")
    assert [tuple(r) for r in S._links(pairs, sets).collect()] == [(2, 3)]


def test_bands_find_pairs_at_the_threshold():
    rnd = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        h = rnd.integers(0, 1 << 64, 100, np.uint64)
        missed += not (S.band_keys(h[:90]) == S.band_keys(np.r_[h[:80], h[90:]])).any()  # 80 of 100
    assert missed == 0


def test_null_ids_other_columns_empty(docs_of):
    schema = "doc_id long, text string, u long, _x string"
    got = S.near_groups(docs_of([(None, "a b c d e f", 1, "x"), (None, "a b c d e f", 2, None), (7, "q r s t u", 3, "z")], schema)).collect()
    assert sorted(r["u"] for r in got) == [1, 2, 3] and sum(r["_sj_first"] for r in got) == 2
    assert S.near_groups(docs_of([], schema)).count() == 0


def test_prefix_pairs_lose_no_pair_of_different_groups(spark):
    rnd = random.Random(8)
    base = [rnd.randrange(200) for _ in range(60)]
    held = {}
    for i in range(120):
        x = set(base[: rnd.choice([10, 40, 60])])
        for _ in range(rnd.randint(0, 12)):
            x.discard(rnd.choice(base))
            x.add(rnd.randrange(260))
        held[i] = x
    groups = {i: rnd.choice([0, 0, 0, 1, 2, i + 10]) for i in held}
    sets = spark.createDataFrame([(i, list(x)) for i, x in held.items()], "s long, held array<long>")
    apart = spark.createDataFrame([(i, len(x), groups[i]) for i, x in held.items()], "s long, n int, g long")
    pairs = S._prefix_pairs(S._prefixes(apart, sets))
    got = {tuple(r) for r in S._links(pairs, sets).collect()}
    want = {(i, j) for i in held for j in held if i < j and groups[i] != groups[j] and 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j])}
    assert got == want and len(want) > 20 and pairs.count() < 60 * 119


def test_golay_keys_bring_near_fingerprints_together(spark):
    """The stage had left out the fingerprints; pairs three bits apart, or of one fingerprint, are its first candidates."""
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        fp = rnd.getrandbits(63)
        rows += [(4 * i, 50, fp), (4 * i + 1, 50, fp), (4 * i + 2, 50, fp ^ sum(1 << b for b in rnd.sample(range(63), 3))), (4 * i + 3, 50, fp ^ sum(1 << b for b in rnd.sample(range(63), 9)))]
    got = {tuple(r) for r in S._golay_pairs(spark.createDataFrame(rows, "s long, n int, fp long")).collect()}
    assert got == {p for i in range(60) for p in ((4 * i, 4 * i + 1), (4 * i, 4 * i + 2))}


def test_groups_take_the_golay_step(spark, docs_of, monkeypatch):
    monkeypatch.setattr(S, "_prefix_pairs", lambda first: first.select(first.s.alias("u"), first.s.alias("v")).limit(0))
    calls = []
    plain = S._golay_pairs
    monkeypatch.setattr(S, "_golay_pairs", lambda sets: calls.append(1) or plain(sets))
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "quite another text of some words here")]
    got = {r["doc_id"]: r["_sj_group"] for r in S.near_groups(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and calls


def test_a_crowd_that_shares_shingles_makes_few_pairs(spark):
    """Sets drawn from the same variants share rare shingles but are far apart: all pairs of them were formed."""
    rnd = random.Random(8)
    made = [[rnd.randrange(3) for _ in range(50)] for _ in range(70)]
    made.append([*made[0][:-1], (made[0][-1] + 1) % 3])  # 245 of 255 are shared
    held = [[hash((slot, pick, i)) >> 1 for slot, pick in enumerate(m) for i in range(5)] for m in made]
    sets = spark.createDataFrame([(s, h) for s, h in enumerate(held)], "s long, held array<long>")
    apart = spark.createDataFrame([(s, len(h), s) for s, h in enumerate(held)], "s long, n int, g long")
    pairs = {tuple(r) for r in S._prefix_pairs(S._prefixes(apart, sets)).collect()}
    assert (0, 70) in pairs and len(pairs) < 20
