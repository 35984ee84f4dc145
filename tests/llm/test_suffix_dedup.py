from __future__ import annotations

import random

import numpy as np

from duskline.llm import suffix_dedup as S


def brute(rows):
    """kept bytes and spans per row, straight from the definition."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            g = b[p:p + 50]
            least[g] = min(least.get(g, S.LAST), S.LAST if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p:p + 50]] < (S.LAST if i is None else i):
                gone[p:p + 50] = True
        spans = int(np.diff(np.r_[0, gone.astype(int)]).clip(0).sum())
        out.append((i, t, np.frombuffer(b, np.uint8)[~gone].tobytes(), spans))
    return sorted(out, key=str)


def check(docs_of, rows):
    got = S.remove_repeats(docs_of(rows)).collect()
    assert sorted([(r["doc_id"], r["text"], bytes(r["_sd_kept"]), len(r["_sd_spans"])) for r in got], key=str) == brute(rows)


def test_random_copies(docs_of):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randint(60, 500))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            t = rnd.choice(base)
            a = rnd.randint(0, len(t))
            parts.append(t[a:a + rnd.randint(0, 200)])
        rows.append((i, "".join(parts)))
    rows += [(None, base[0]), (None, base[1] + "x"), (90, None), (91, ""), (92, base[3]), (92, base[3]), (92, base[4]), (93, "z" * 49), (94, "z" * 49), (95, "z" * 50), (96, "z" * 500),
             (97, "z" * 51 + "\0" * 60), (98, "\0" * 55), (-5, base[5])]
    check(docs_of, rows)


def test_hot_passage_and_low_entropy(docs_of):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    common = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(5)) + common + " ".join(word() for _ in range(5))) for i in range(200)]
    rows += [(i, "ab" * rnd.randint(10, 300)) for i in range(200, 230)]
    check(docs_of, rows)


def test_long_document_is_cut_into_blocks(docs_of, monkeypatch):
    rnd = random.Random(7)
    text = "".join(rnd.choice("abcdefghij") for _ in range(3000))
    data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    whole = S.anchors(data, offs[:1], offs[1:])[0]
    monkeypatch.setattr(S, "BLOCK", 256)
    pieces = [S.anchors(data[lo:hi], np.array([0]), np.array([hi - lo]))[0] + lo for _, _, lo, hi in S._blocks(offs)]
    assert len(pieces) > 5 and set(np.concatenate(pieces)) == set(whole)


def test_merge_equals_sorting():
    rnd = np.random.default_rng(3)
    rows = rnd.integers(97, 99, (200, S.WINDOW), dtype=np.uint8)
    rows[100:] = rows[:100]
    rows[100:, 60] = 120
    shards = [S.shard_transform(rows[:70]), S.shard_transform(rows[70:])]
    for c, order, lcp in S.merge_transforms(shards):
        tails = [bytes(rows[i, c:]) for i in order]
        assert tails == sorted(tails)
        for i in range(1, len(tails)):
            same = next((j for j, (x, y) in enumerate(zip(tails[i - 1], tails[i], strict=True)) if x != y), len(tails[i]))
            assert lcp[i] == same


def test_other_columns_and_empty_table(docs_of):
    rows = [(1, "a" * 60, 7, "s"), (2, "a" * 60 + "b", None, None)]
    schema = "doc_id long, text string, bucket int, blob string"
    got = {r["doc_id"]: r for r in S.remove_repeats(docs_of(rows, schema)).collect()}
    assert got[1]["bucket"] == 7 and bytes(got[2]["_sd_kept"]) == b"b" and got[2]["_sd_spans"][0]["end"] == 60
    assert S.remove_repeats(docs_of([], schema)).count() == 0


def test_windows_merged_in_parts_give_the_same_strings(monkeypatch):
    rnd = np.random.default_rng(4)
    text = rnd.integers(97, 101, 4000).astype(np.uint8)
    at = rnd.integers(0, len(text) - S.WINDOW, 600)
    wins = np.lib.stride_tricks.sliding_window_view(text, S.WINDOW)[np.r_[at, at[:300]]]
    doc, left, right = rnd.integers(0, 9, 900), np.full(900, S.SIDE, np.uint8), np.full(900, S.WIDTH, np.uint8)
    want = S.repeated_starts(wins, doc, left, right)
    sizes, real = [], S.repeated_starts
    monkeypatch.setattr(S, "ROWS", 100)
    monkeypatch.setattr(S, "repeated_starts", lambda w, *rest: sizes.append(len(w)) or real(w, *rest))
    # strings are judged at the windows of their own anchor; here all columns are compared where an anchor is shared
    got = S._starts_by_part(wins, doc, left, right)
    assert max(sizes) < 300 and sum(sizes) == 900
    own = np.uint64(1 << S.SIDE)
    assert want.any() and (((got ^ want) & own) == 0).all() and ((got & ~want) == 0).all()


def test_texts_leave_a_bucket_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    from duskline.llm.common import blob_batch

    monkeypatch.setattr(S, "BLOCK", 1000)
    texts = [None if i % 7 == 0 else "x" * (i * 37 % 300) for i in range(200)] + ["y" * 5000]
    ids = pa.array(range(201), pa.int64())
    docs = pa.table({"doc_id": ids, "text": texts, "_sd_id": ids, "_sd_key": ids})
    out = S._cut_task(["doc_id", "text"], "text")(docs, pa.Table.from_batches([blob_batch([])]))
    assert out["text"].to_pylist() == texts and out["_sd_text"].to_pylist() == [t or "" for t in texts]
    assert sorted(sum(map(len, b["_sd_text"].to_pylist())) for b in out.to_batches())[-2:][0] <= 1000
    assert S._cut_task(["doc_id", "text"], "text")(docs.slice(0, 0), pa.Table.from_batches([blob_batch([])])).num_rows == 0
