from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duskline.llm import wavelet_store as S

PATH = P.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def plain(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, S.END]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aZé'.,!$ñß sm\n\t ́İK<|>end12", max_size=40)))
def test_words_equal_whole_texts(text):
    assert S.encode_texts([text], PATH)[0].tolist() == plain(text)


def test_matrix():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.integers(0, 37, n).astype(np.uint16)
        m, docs, known, ends = S.read_shard(S.write_shard(ids, np.array([4, 9]), np.array([True, False]), np.array([n // 2, n]), 6))
        assert (m.everything() == ids).all() and ends.tolist() == [n // 2, n] and docs.tolist() == [4, 9] and known.tolist() == [1, 0]
        assert (m.access(np.arange(n)) == ids).all()
        for v in (0, 5, 36, 40):
            assert m.places(v).tolist() == np.flatnonzero(ids == v).tolist()
            for a, b in ((0, n), (n // 3, n // 2)):
                assert m.count(v, a, b) == int((ids[a:b] == v).sum())


def test_store(docs_of, tmp_path):
    rows = [(i, f"Word{i}, It's number {i} naïve <|endoftext|> x" * (i % 7), "s") for i in range(300)]
    rows += [(None, "null id", "s"), (7, "again", "s"), (7, "again", "s"), (8, None, "s"), (9, "", "s"), (10, "long " * 50000, "s")]
    df = docs_of(rows, "doc_id long, text string, ids string").repartition(6)
    S.write_files(df, PATH, str(tmp_path / "shards"), shard_tokens=2000)
    got = S.read_files(df.sparkSession, str(tmp_path / "shards")).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    start, want = 0, []
    for d, t, _ in order:
        ids = plain(t)
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert S.store(docs_of([]), PATH).count() == 0
