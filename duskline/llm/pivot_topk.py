"""Exact top-k inner products by pivot-table elimination.

Vectors are integer. PIVOTS vectors, the same for all, are chosen by hash of
their id (a bounded, documented number), and every vector stores its distances
to all of them. For a query q and a vector x, the largest difference of their
distances to a pivot bounds |q - x| from below, and so the inner product
(|q|^2 + |x|^2 - |q - x|^2) / 2 from above. In a block, vectors are taken in
order of that bound and evaluated exactly until the k-th best score is above
the next bound; ties of the bound are still evaluated, so the result is exact.

Queries and vectors meet in blocks: vectors are dealt to one of C blocks and
queries to one of Q, each pair of blocks is one task, and each task returns k
rows per query. The best k of the C results are ranked at last.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part; shorter vectors count as padded with zeros; a query
row never meets itself, but meets other rows with its id; components are to be
below 2^31 after scaling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.llm.common import width
from duskline.session import settled

PIVOTS = 48
FIRST = 64
_FOUND = "query_id long, query_row long, vec_id long, score long"


def integer_vector(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _index(pivots: list[list[int]], dim: int):
    def run(batches):
        p = _matrix(pivots, dim).astype(np.float64)
        for b in batches:
            x = _matrix(b["v"].to_pylist(), dim)
            xf = x.astype(np.float64)
            far = np.sqrt(np.maximum((xf ** 2).sum(1)[:, None] + (p ** 2).sum(1)[None, :] - 2 * xf @ p.T, 0))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["row"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in far], pa.binary())],
                                             names=["vec_id", "row", "v", "far"])

    return run


def _unpacked(t: pa.Table, dim: int):
    n = t.num_rows
    whole = lambda c, kind, m: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(n, m)
    return t["vec_id"].to_numpy(), t["row"].to_numpy(), whole("v", np.int64, dim), whole("far", np.float64, -1 if n else 0)


class Block:
    """Vectors of one block with what every query needs of them.

    Products run in double precision where no sum of them can pass 2^53, so that they are exact, else in integers.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray, largest: int):
        self.ids = ids
        exact = x.shape[1] * int(np.abs(x).max(initial=0)) * largest < 1 << 53
        self.x = x.astype(np.float64) if exact else x
        self.far = np.ascontiguousarray(far.T)
        self.norms = (x.astype(np.float64) ** 2).sum(1)

    def bounds(self, q: np.ndarray, q_far: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products with q."""
        low, gap = np.zeros(len(self.ids)), np.empty(len(self.ids))
        for line, f in zip(self.far, q_far.tolist(), strict=True):
            np.maximum(low, np.abs(np.subtract(line, f, out=gap), out=gap), out=low)
        return ((q.astype(np.float64) ** 2).sum() + self.norms - np.maximum(low - 1e-6 * (1 + low), 0) ** 2) / 2 + 1e-6 * (1 + self.norms)


def best_of(q: np.ndarray, q_far: np.ndarray, block: Block, skip: list[int], k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one query in one block; skip: positions left out."""
    bound = block.bounds(q, q_far)
    bound[skip] = -np.inf
    order = np.argsort(-bound, kind="stable")[:len(bound) - len(skip)]
    q = q.astype(block.x.dtype)
    scores, ids = np.zeros(0, block.x.dtype), np.zeros(0, np.int64)
    at, step = 0, FIRST
    while at < len(order) and not (len(ids) == k and scores[-1] > bound[order[at]]):
        some = order[at:at + step]
        scores, ids = np.r_[scores, block.x[some] @ q], np.r_[ids, block.ids[some]]
        if len(ids) > k:  # all that reach the k-th best score, ties included
            high = scores >= np.partition(scores, len(ids) - k)[len(ids) - k]
            scores, ids = scores[high], ids[high]
        top = np.lexsort((ids, -scores))[:k]
        scores, ids = scores[top], ids[top]
        at, step = at + step, step * 2
    return [(int(s), i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]


def _search(dim: int, k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and vectors.num_rows:
            x_ids, x_rows, x, x_far = _unpacked(vectors, dim)
            q_ids, q_rows, qs, q_fars = _unpacked(queries, dim)
            block = Block(x_ids, x, x_far, int(np.abs(qs).max(initial=0)))
            place = {r: i for i, r in enumerate(x_rows.tolist())}
            for qi, qr, q, q_far in zip(q_ids.tolist(), q_rows.tolist(), qs, q_fars, strict=True):
                skip = [place[qr]] if qr in place else []
                out += [(qi, qr, i, s) for s, i in best_of(q, q_far, block, skip, k)]
        return pa.table({n: pa.array([r[c] for r in out], pa.int64()) for c, n in enumerate(("query_id", "query_row", "vec_id", "score"))})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id long, v array<long>; is_query: condition on vec_id."""
    spark = vectors.sparkSession
    c = width(spark)
    q = 1 + c // 64
    live = vectors.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "v")
    chosen = live.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id", "v").limit(pivots).collect()
    dim = live.agg(F.max(F.size("v"))).first()[0] or 1
    numbered = live.withColumn("row", F.monotonically_increasing_id())
    index = settled(numbered.mapInArrow(_index([r["v"] for r in chosen], dim), "vec_id long, row long, v binary, far binary"))
    part = F.pmod(F.xxhash64("row"), F.lit(c)).cast("int")
    asked = index.where(is_query).withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(q)).cast("int"))
    asked = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    held = index.withColumn("cb", part).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    found = asked.groupBy("qb", "cb").cogroup(held.groupBy("qb", "cb")).applyInArrow(_search(dim, k), _FOUND)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
