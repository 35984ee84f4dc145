from __future__ import annotations

import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from duskline.llm import bpe_duckdb as B

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, "a", "  two  blanks ", "it's 12345 o'clock\n\n\t x", "naïve 漢字 😀😀 ​", "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 300, "ab" * 40000, "<|endoftext|>", "hello " * 3000, "\x00\x01"]


def test_documents_equal_the_library(docs_of, plain):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, "null id", None)]
    df = B.decode(B.encode(docs_of(rows, "doc_id long, text string, tok string"), P.PATTERN, RANKS), RANKS)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["_bp_ids"] == plain.encode_ordinary(r["text"] or "") and bytes(r["_bp_bytes"]) == (r["text"] or "").encode()
    again = B.round_trip(docs_of(rows, "doc_id long, text string, tok string"), P.PATTERN, RANKS).collect()
    key = lambda r: (str(r["doc_id"]), r["_bp_ids"])
    assert [(key(r), bytes(r["_bp_bytes"])) for r in sorted(again, key=key)] == [(key(r), bytes(r["_bp_bytes"])) for r in sorted(got, key=key)]
    assert B.encode(docs_of([]), P.PATTERN, RANKS).count() == 0 and B.round_trip(docs_of([]), P.PATTERN, RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_round_trip(plain, texts):
    ids = B.encode_texts(texts, P.PATTERN, RANKS)
    assert [x.tolist() for x in ids] == [plain.encode_ordinary(t) for t in texts]
    offs = np.cumsum([0, *map(len, ids)])
    assert B.decode_ids(np.concatenate(ids), offs, RANKS) == [t.encode() for t in texts]


@pytest.mark.parametrize("size", [15, 16, 17, 63, 64, 65])
def test_full_pieces_stay_apart(plain, size):
    """The last byte of a piece that fills its keys does not merge with the next piece."""
    pieces = [b"4" + b"1" * (size - 1), b"0", b" " * size, b"a", b"x" * size, b"e", b"1" * size, b"1" * size]
    want = [plain._encode_single_piece(p) for p in pieces]
    assert [x.tolist() for x in B.encode_pieces(pieces, RANKS)] == want
    text = "a\n4" + "1" * (size - 2) + "a\n0"
    assert B.encode_texts([text], P.PATTERN, RANKS)[0].tolist() == plain.encode_ordinary(text)
