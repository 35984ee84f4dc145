"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target share of all words (weights, capped at a multiple of
its own size, the excess shared again by weight). A source is taken whole as
often as fits; for the rest of its target, documents are chosen by length:
1. documents are counted by (source, length), with map-side folding;
2. the rest is dealt to lengths in proportion, then what is left is fitted by a
   bounded-knapsack table over the counts (budget at most WINDOW words, so the
   table has a fixed size);
3. which documents of a length are taken follows a seeded hash. A length shared
   by very many documents is split into slots of that hash: quotas run over
   slots, ranks stay inside one, so no group has to fit a task.

Only the histogram of one source (at most its number of different lengths) is
seen by one task. Defined cases: a null size counts as 0; a null source is a
source of its own, the last; documents of size 0 are taken 0 words; equal rows
are told apart by rank only, so their number is right; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.llm.common import width
from duskline.session import settled

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 17
#: Largest budget that the knapsack table is built for.
WINDOW = 1 << 15


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII blanks; null: 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, at most counts, so that the sum comes as near below the budget as the table shows."""
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    take = np.zeros(len(sizes), np.int64)
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.minimum(counts, np.array([int(c) * budget // total for c in counts]))
    left = budget - int((take * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= WINDOW:
            break
        if sizes[i]:
            more = min(int(counts[i] - take[i]), -(-(left - WINDOW) // int(sizes[i])), left // int(sizes[i]))
            take[i] += more
            left -= more * int(sizes[i])
    full, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in np.argsort(-(counts - take), kind="stable"):
        spare, part, s = int(counts[i] - take[i]), 1, int(sizes[i])
        while spare > 0 and s and s <= left and not reach >> left & 1:
            n = min(part, spare)
            if n * s > left:
                break
            steps.append((reach, i, n))
            reach |= (reach << n * s) & full
            spare, part = spare - n, part * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for before, i, n in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(sizes[i])
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    take = fit(pdf["_bm_size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["rest"].iloc[0]))
    return pdf[["_bm_no", "_bm_src", "_bm_size"]].assign(picks=take)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_bm_no, _bm_src, source_size, target) of each source; sized has the flag of a missing source, its name and the size."""
    totals = sized.groupBy("_bm_no", "_bm_src").agg(F.sum("_bm_size").alias("source_size"))
    rank = F.row_number().over(W.orderBy("_bm_no", "_bm_src"))  # one row per source
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((rank - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("w", weight).withColumn("most", cap * F.col("source_size"))
    before = W.orderBy(F.col("most") / F.col("w"), "_bm_no", "_bm_src").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    unit = ((share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
            / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    filled = ranked.withColumn("unit", unit).withColumn("bound", F.col("unit") * F.col("w") >= F.col("most"))
    # in order of most / w, the first source that is not held at its cap has the final unit
    level = F.min(F.when(~F.col("bound"), F.struct(F.col("most") / F.col("w"), "_bm_no", "_bm_src", "unit"))).over(every)["unit"]
    return filled.withColumn("level", level).select(
        "_bm_no", "_bm_src", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("w")), F.col("most")).alias("target"))


def mix(docs: DataFrame, size_col: str, source_col: str = "source", id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
        seed: int = SEED) -> DataFrame:
    """All columns of docs, `_bm_source_size`, `_bm_target` and `_bm_copies` (whole copies of the document in the mix)."""
    keys = ["_bm_no", "_bm_src"]
    slots = width(docs.sparkSession)
    source = F.col(f"`{source_col}`")
    draw = F.xxhash64(F.lit(seed), f"`{id_col}`")
    marked = settled(docs.withColumns({
        "_bm_size": F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), "_bm_no": source.isNull(), "_bm_src": F.coalesce(source.cast("string"), F.lit("")),
        "_bm_draw": draw, "_bm_slot": F.pmod(F.shiftright(draw, 20), F.lit(slots)).cast("int")}))
    targets = settled(source_targets(marked.select(*keys, "_bm_size"), weights, share, cap))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    plan = targets.withColumn("whole", whole.cast("int")).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    slotted = settled(marked.groupBy(*keys, "_bm_size", "_bm_slot").agg(F.count("*").alias("n")))
    lengths = slotted.groupBy(*keys, "_bm_size").agg(F.sum("n").alias("n")).join(plan.select(*keys, "rest"), keys)
    picks = lengths.groupBy(*keys).applyInPandas(_fit_source, "_bm_no boolean, _bm_src string, _bm_size long, picks long")
    run = W.partitionBy(*keys, "_bm_size").orderBy("_bm_slot").rowsBetween(W.unboundedPreceding, -1)
    quota = (slotted.join(picks, [*keys, "_bm_size"]).withColumn("quota", F.col("picks") - F.coalesce(F.sum("n").over(run), F.lit(0)))
             .select(*keys, "_bm_size", "_bm_slot", F.greatest("quota", F.lit(0)).alias("_bm_quota")))
    rank = F.row_number().over(W.partitionBy(*keys, "_bm_size", "_bm_slot").orderBy("_bm_draw", f"`{id_col}`"))
    dealt = marked.withColumn("_bm_rank", rank).join(quota, [*keys, "_bm_size", "_bm_slot"], "left").join(
        plan.select(*keys, F.col("source_size").alias("_bm_source_size"), F.col("target").alias("_bm_target"), F.col("whole").alias("_bm_whole")), keys, "left")
    copies = F.col("_bm_whole") + F.when(F.col("_bm_rank") <= F.coalesce("_bm_quota", F.lit(0)), 1).otherwise(0)
    return dealt.select(*[f"`{c}`" for c in docs.columns], "_bm_source_size", "_bm_target", copies.cast("int").alias("_bm_copies"))
