"""Token counts of whole texts without token ids.

Every task cuts its texts into pre-tokens, counts them per document, and writes
them as numbers into a list of the different pre-tokens of a block of texts.
Both are settled. The lists are dealt by a hash of the pre-token, so that each
different pre-token of the corpus meets in one task and is encoded once; its
number of tokens goes back to the blocks, whose lists are joined with their
documents' frequencies, and frequency times tokens is summed. A pre-token that
stands in every document is one entry for a block, never one for a document.

The tokenizer is a file for the `tokenizers` library with byte-level BPE and
its own pattern; another normaliser, pre-tokenizer or added tokens with
stripping rules are refused. Strings of added tokens inside texts count as the
library counts them by default, one each, and cut the text.

Defined cases: a null or empty text has no bytes and no tokens; equal rows get
equal results; no rows give no rows; other columns are passed through.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import Counter
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from duskline.llm.common import pack, unpack, width
from duskline.session import settled

#: Bytes of text whose pre-tokens share one list, and different pre-tokens after which a list ends.
BLOCK = 32 << 20
LISTED = 1_000_000
#: Different pre-tokens whose numbers of tokens a task remembers.
REMEMBERED = 2_000_000
#: Pre-tokens encoded at a time.
AT_ONCE = 20_000
#: The pattern of byte-level pre-tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Cutter:
    """Cuts texts as the library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if not plain or spec["normalizer"] or odd or spec["model"]["type"] != "BPE" or spec.get("post_processor"):
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = regex.compile(PATTERN).findall
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.newer = _newer()

    def pieces(self, text: str) -> list[str]:
        if self.newer.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def counted(self, text: str) -> tuple[Counter, int]:
        """Frequency of each pre-token, and the number of added tokens."""
        if self.added is None or not self.added.search(text):
            return Counter(self.pieces(text)), 0
        parts = self.added.split(text)
        total = Counter()
        for p in parts:
            total.update(self.pieces(p))
        return total, len(parts) - 1

    def tokens(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


@cache
def _newer() -> regex.Pattern:
    """Letters, numbers and spaces of newer Unicode versions, which the library may not know as such; it cuts texts with them itself."""
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    found = [ord(c) for c in regex.findall(r"[\s\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    cuts = np.flatnonzero(np.diff(found, prepend=-1, append=1 << 30) != 1)
    return regex.compile("[%s]" % "".join(f"{chr(found[i])}-{chr(found[j - 1])}" for i, j in zip(cuts[:-1], cuts[1:], strict=True)) if found else "(?!)")


@cache
def _cutter(path: str) -> Cutter:
    return Cutter(path)


def _cut(text_col: str, path: str, room: int, buckets: int):
    def run(batches):
        cutter, part, name = _cutter(path), TaskContext.get().partitionId(), count()
        block, size, lines, row_type = (part << 33) + next(name), 0, {}, None

        def listed():
            held: list[list] = [[] for _ in range(buckets)]
            for p, line in lines.items():
                raw = p.encode()
                held[zlib.crc32(raw) % buckets].append((line, raw))
            for bucket, some in enumerate(held):
                if some:
                    at, raws = zip(*some, strict=True)
                    blobs = [_planes(np.diff(at, prepend=0)), _planes(np.array(list(map(len, raws)))), zstandard.compress(b"".join(raws), 3)]
                    yield _row(block, bucket, None, blobs, row_type)

        for b in batches:
            row_type = b["row"].type
            texts = b[text_col].to_pylist()
            n_bytes = np.array([len((t or "").encode()) for t in texts], np.int64)
            added, ends, at, times = [], [0], [], []
            for t in texts:
                found, n = cutter.counted(t) if t else ({}, 0)
                added.append(n)
                for p in found:
                    at.append(lines.setdefault(p, len(lines)))
                times += found.values()
                ends.append(len(at))
            sizes = np.diff(ends)
            at, times, doc = np.array(at, np.int64), np.array(times, np.int64), np.repeat(np.arange(len(texts)), sizes)
            order = np.lexsort((at, doc))
            at = at[order]
            step = np.diff(at, prepend=0)
            first = np.array(ends[:-1], np.int64)[sizes > 0]
            step[first] = at[first]  # lines ascend in a document, so steps are small
            yield _row(block, None, b["row"], [pack(n_bytes, np.array(added, np.int64), sizes.astype(np.int64)), _planes(step), _planes(times[order])], row_type)
            size += int(n_bytes.sum())
            if size >= room or len(lines) >= LISTED:
                yield from listed()
                block, size, lines = (part << 33) + next(name), 0, {}
        yield from listed()

    return run


def _planes(a: np.ndarray) -> bytes:
    """First bytes of all numbers, then all second bytes, and so on, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _numbers(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).ravel().view("<u4").astype(np.int64)


def _row(block, bucket, rows, blobs, row_type) -> pa.RecordBatch:
    kept = pa.array([None], pa.list_(row_type)) if rows is None else pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), kept, pa.array([blobs], pa.list_(pa.binary()))],
                                      names=["block", "bucket", "rows", "blobs"])


def _encoding(path: str):
    """Lists (block, blobs) -> lines and their numbers of tokens; pre-tokens of all lists of the task are encoded once."""

    def run(batches):
        cutter, known = _cutter(path), {}
        for b in batches:
            for block, blobs in zip(b["block"].to_pylist(), b["blobs"].to_pylist(), strict=True):
                ends, raw = np.cumsum(_numbers(blobs[1])), zstandard.decompress(blobs[2])
                pieces = [raw[lo:hi].decode() for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                fresh = [p for p in pieces if p not in known]
                for at in range(0, len(fresh), AT_ONCE):
                    some = fresh[at:at + AT_ONCE]
                    known.update(zip(some, cutter.tokens(some), strict=True))
                n = _planes(np.array([known[p] for p in pieces]))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blobs[0]], pa.binary()), pa.array([n], pa.binary())], names=["list", "lines", "n"])
                if len(known) > REMEMBERED:
                    known = {}

    return run


def _summing(key, docs: pa.Table, pieces: pa.Table) -> pa.Table:
    lists = [(np.cumsum(_numbers(at.as_py())), _numbers(n.as_py())) for at, n in zip(pieces["lines"], pieces["n"], strict=True)]
    n = np.zeros(1 + max((int(at[-1]) for at, _ in lists), default=-1), np.int64)
    for at, tokens in lists:
        n[at] = tokens
    rows, n_bytes, n_tokens = [], [], []
    for kept, blobs in zip(docs["rows"], docs["blobs"], strict=True):
        head, steps, times = (x.as_py() for x in blobs.values)
        size, added, pieces_of = unpack([head], np.int64, np.int64, np.int64)
        ends = np.r_[0, np.cumsum(pieces_of)]
        run = np.r_[0, np.cumsum(_numbers(steps))]
        at = run[1:] - np.repeat(run[ends[:-1]], pieces_of)
        total = np.r_[0, np.cumsum(n[at] * _numbers(times))]
        rows.append(kept.values)
        n_bytes.append(size)
        n_tokens.append(total[ends[1:]] - total[ends[:-1]] + added)
    joined = pa.chunked_array(rows, docs.schema.field("rows").type.value_type)
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_bytes, n_tokens)]
    return pa.table([joined, pa.array(flat[0]), pa.array(flat[1])], names=["row", "_tc_bytes", "_tc_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: list[str] | None = None, room: int = BLOCK) -> DataFrame:
    """Columns `keep` (default: all) of docs, `_tc_bytes` (UTF-8) and `_tc_tokens`.

    room: bytes of text that share a list.

    The tokenizer file is read by name inside each worker, as an installed
    package is.
    """
    keep = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.lit(0).alias("_"))
    text = F.col(f"`{text_col}`").cast("string").alias("_tc_text")
    picked = docs.select(row.alias("row"), text)
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in picked.schema["row"].dataType.fields])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("rows", T.ArrayType(kind)),
                           T.StructField("blobs", T.ArrayType(T.BinaryType()))])
    tasks = width(docs.sparkSession)
    cut = settled(picked.mapInArrow(_cut("_tc_text", tokenizer, room, 2 * tasks), schema))
    lists = cut.where(F.col("bucket").isNotNull()).select("bucket", "block", "blobs").repartition(tasks, "bucket").select("block", "blobs")
    tokens = lists.mapInArrow(_encoding(tokenizer), "list long, lines binary, n binary")
    counted = cut.where(F.col("bucket").isNull()).select("block", "rows", "blobs").groupBy("block").cogroup(tokens.groupBy("list")).applyInArrow(
        _summing, T.StructType([T.StructField("row", kind), T.StructField("_tc_bytes", T.LongType()), T.StructField("_tc_tokens", T.LongType())]))
    return counted.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)], "_tc_bytes", "_tc_tokens")
