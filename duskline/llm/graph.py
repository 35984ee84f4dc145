"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.session import settled

_EDGE = "u long, v long"


def _forest(batches):
    """Spanning stars of the edges of one task; ids that are connected here get one edge to their smallest."""
    got = [np.stack([b["u"].to_numpy(), b["v"].to_numpy()]) for b in batches if b.num_rows]
    if not got:
        return
    ids, flat = np.unique(np.concatenate(got, axis=1), return_inverse=True)
    u, v = flat.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    move = root != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[move]), pa.array(ids[root[move]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each id that has an edge and is not its component's smallest, with the smallest.

    Edges of one task are first folded to stars. Then, round by round, every id
    links its larger neighbours, and itself with its smaller ones, to its smallest
    neighbour, until nothing changes. Each round is written to the shared folder.
    """
    now = settled(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_forest, _EDGE).distinct())
    mark = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign[0] == 0 or sign == mark:
            return now
        mark = sign
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = settled(large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                      .union(small.select("u", F.col("m").alias("v"))).distinct())
