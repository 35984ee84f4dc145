"""Quality by weak labels: heuristic labellers, EM for their accuracies, a linear scorer.

1. Labellers vote good, bad or nothing on every whole text.
2. Vote patterns are counted over all documents (at most 3^labellers rows) and
   expectation-maximisation estimates how each labeller votes on good and on bad
   documents, taking votes as independent given the quality; every pattern gets a
   posterior.
3. Posteriors label a bounded sample (TRAIN_ROWS documents by hash of the id,
   whole texts), on which a linear scorer is fitted: hashed byte triplets, log
   frequencies. The model has a fixed size and scores all documents in one pass.

Defined cases: null and empty texts get the vote of the length labeller alone
and are scored like any other; repeated rows are counted as often as they stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.common import text_bytes
from duskline.session import settled

BUCKETS = 1 << 12
TRAIN_ROWS = 4000
ROUNDS = 60
LABELLERS = 6
_SYMBOLS = re.compile(rb"[!-/:-@\[-`{-~]{3,}")
_LETTERS = bytes(b for b in range(256) if chr(b).isalpha() and b < 128 or b >= 128)
_ENDS = (b".", b"!", b"?")
_CAPITALS = [bytes([b]) for b in range(65, 91)]
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _vote(good: bool, bad: bool) -> int:
    return 1 if good else -1 if bad else 0


def votes(text: bytes) -> list[int]:
    """One vote per labeller: 1 good, -1 bad, 0 none."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = len(words)
    if n < 5:
        return [0, 0, 0, 0, 0, -1]
    dense = sum(map(len, words))
    letters = (len(text) - len(text.translate(None, _LETTERS))) / dense
    fresh = len(set(lines)) / len(lines)
    marked = len(_SYMBOLS.findall(text)) / n
    ended = sum(w.endswith(_ENDS) for w in words) / n
    varied = len(set(words)) / n
    capitals = sum(map(text.count, _CAPITALS)) / max(1, len(text) - len(text.translate(None, _LETTERS)))
    bare = sum(not w.strip(_SIGNS) for w in words) / n
    return [_vote(letters > 0.9, letters < 0.75), _vote(fresh > 0.95 and len(lines) > 1, fresh < 0.7), _vote(marked < 0.01, marked > 0.2 or bare > 0.2),
            _vote(0.02 < ended < 0.3, ended > 0.6 or (n > 60 and ended < 0.005)), _vote(n > 40 and varied > 0.5, n > 40 and varied < 0.3), _vote(n > 30 and capitals < 0.3, capitals > 0.6)]


def _voting(names: list[str], text_col: str):
    def run(batches):
        for b in batches:
            codes = [sum((v + 1) * 3 ** i for i, v in enumerate(votes((t or "").encode()))) for t in b[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(codes, pa.int32())], names=[*names, "_wq_votes"])

    return run


def estimate(codes: np.ndarray, counts: np.ndarray, labellers: int = LABELLERS) -> tuple[np.ndarray, np.ndarray]:
    """(accuracy of each labeller where it votes, posterior of good for each pattern) by expectation-maximisation.

    Each labeller has its own chances of voting good, bad or nothing in either
    class. The start takes any bad vote for a bad document.
    """
    v = codes[:, None] // 3 ** np.arange(labellers) % 3 - 1
    good = np.where((v < 0).any(axis=1), 0.2, 0.9)
    for _ in range(ROUNDS):
        part = np.stack([counts * (1 - good), counts * good])
        said = np.stack([part @ (v == k) for k in (-1, 0, 1)], axis=2)  # class x labeller x vote
        chance = (said + 1) / (said.sum(axis=2, keepdims=True) + 3)
        share = np.clip(part.sum(axis=1) / max(1, counts.sum()), 0.02, 0.98)
        weight = np.stack([np.log(share[c]) + np.log(chance[c][np.arange(labellers), v + 1]).sum(axis=1) for c in (0, 1)])
        good = 1 / (1 + np.exp(weight[0] - weight[1]))
    return (said[0, :, 0] + said[1, :, 2] + 1) / (said[:, :, [0, 2]].sum(axis=(0, 2)) + 2), good


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Log frequencies of hashed byte triplets of each text."""
    n, docs = len(buf), len(offs) - 1
    counts = np.zeros(docs * BUCKETS, np.int64)
    if n > 2:
        wide = buf.astype(np.uint32)
        h = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(0x9E3779B1)
        doc = np.repeat(np.arange(docs), np.diff(offs))
        at = (h >> np.uint32(20)).astype(np.int64) + doc[:-2] * BUCKETS
        counts = np.bincount(at[doc[:-2] == doc[2:]], minlength=docs * BUCKETS)
    x = counts.reshape(docs, BUCKETS) / np.maximum(1, np.diff(offs))[:, None]
    return np.log1p(1000 * x).astype(np.float32)


def _fitting(batches):
    got = [(features(*text_bytes(b["text"])), b["good"].to_numpy(zero_copy_only=False)) for b in batches]
    if not got:
        return
    x, y = np.vstack([g[0] for g in got]), np.concatenate([g[1] for g in got])
    mean, w, level = x.mean(axis=0), np.zeros(BUCKETS, np.float32), 0.0
    x, squares, s0 = x - mean, np.full(BUCKETS, 1e-3), 1e-3
    for _ in range(150):
        err = 1 / (1 + np.exp(-np.clip(x @ w + level, -30, 30))) - y
        g, g0 = x.T @ err / len(y) + 1e-3 * w, err.mean()
        squares, s0 = squares + g * g, s0 + g0 * g0
        w, level = (w - 0.05 * g / np.sqrt(squares)).astype(np.float32), level - 0.05 * g0 / np.sqrt(s0)
    yield pa.RecordBatch.from_arrays([pa.array([np.r_[w, level - mean @ w].astype(np.float32).tobytes()], pa.binary())], names=["model"])


def _scoring(names: list[str], text_col: str, raw: bytes | None):
    def run(batches):
        model = np.frombuffer(raw, np.float32) if raw else np.zeros(BUCKETS + 1, np.float32)
        for b in batches:
            z = features(*text_bytes(b[text_col])) @ model[:-1] + model[-1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60))))], names=[*names, "_wq_score"])

    return run


def quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """Columns `keep` (default: all) of docs and `_wq_score`, the chance that the document is good."""
    keep = docs.columns if keep is None else keep
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    voted = settled(base.mapInArrow(_voting(["id"], "text"), T.StructType([base.schema["id"], T.StructField("_wq_votes", T.IntegerType())])))
    counted = voted.groupBy("_wq_votes").count().collect()  # at most 3^6 rows
    codes, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.float64)
    model = None
    if len(codes):
        good = estimate(codes, counts)[1]
        posterior = F.create_map(*[F.lit(x) for pair in zip(codes.tolist(), good.tolist(), strict=True) for x in pair])
        chosen = voted.dropna().distinct().orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(rows).withColumn("good", posterior[F.col("_wq_votes")])
        got = base.join(F.broadcast(chosen), "id").repartition(1).mapInArrow(_fitting, "model binary").collect()
        model = bytes(got[0]["model"]) if got else None
    names = list(keep)
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("_wq_score", T.DoubleType())])
    return docs.select(*{f"`{c}`": 0 for c in [*names, text_col]}).mapInArrow(_scoring(names, text_col, model), schema)
