from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from duskline.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello  world, it's 10 o'clock\n\n  x", "", None, "<|endoftext|>", "a<|endoftext|>  <|endoftext|>b  ", "<|endoftext", "ünïcode 中文 \U0001f600!!", " ", "   \t\n ",
         "x" * 5000, "'s's''s 'S", "\x00\x1c\x85\xa0  z", "caf́e ՘a꟎b \U000323b0\U000323b1x", "Hello  world, it's 10 o'clock\n\n  x"]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_counts_equal_the_library(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = token_counts.count_tokens(docs_of(rows).repartition(3), PATH).orderBy("doc_id").collect()
    assert [r["_tc_tokens"] for r in got] == expected(TEXTS)
    assert [r["_tc_bytes"] for r in got] == [len((t or "").encode()) for t in TEXTS]
    assert [r["text"] for r in got] == TEXTS


def test_many_small_blocks(docs_of):
    rows = [(i % 5, TEXTS[i % len(TEXTS)]) for i in range(1400)]
    got = token_counts.count_tokens(docs_of(rows).coalesce(1), PATH, keep=["doc_id"], room=40).collect()
    want = expected([t for _, t in rows])
    assert sorted((r["doc_id"], r["_tc_tokens"]) for r in got) == sorted((i, n) for (i, _), n in zip(rows, want, strict=True))


def test_clashing_and_empty(docs_of):
    schema = "text string, block long, row string, pieces int, n int, _tc_x string"
    got = token_counts.count_tokens(docs_of([("one two", 7, "r", 1, None, None), (None, None, None, None, None, "y")], schema), PATH).collect()
    assert sorted((r["text"] or "", r["block"], r["row"], r["_tc_tokens"]) for r in got) == [("", None, None, 0), ("one two", 7, "r", 2)]
    assert token_counts.count_tokens(docs_of([]), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Cutter(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op12_token_counts(spark, sf).collect()}
    for d, n in zip(docs, expected([d["text"] for d in docs]), strict=True):
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((d["text"] or "").encode()), n > 1024)
