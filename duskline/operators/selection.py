"""Rank-based screens: components, scores, top shares, uncertainty and decision multiverses.

Cell tables are unbounded, so every rank, quantile and top share here comes
from the range-cut operators in `ranks`, grouped by layer, replicate or decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.functions.numeric import safe_div
from duskline.operators.ranks import by_share, pct_rank, top_shares

# Components, weight scenarios before normalisation, shares.
COMPONENTS = ("heat", "elderly", "cooling", "intensity")
BASE_WEIGHTS = {
    "baseline": (0.40, 0.30, 0.20, 0.10),
    "equal_components": (1.0, 1.0, 1.0, 1.0),
    "heat_focused": (0.50, 0.20, 0.15, 0.15),
    "older_resident_focused": (0.20, 0.50, 0.15, 0.15),
    "cooling_focused": (0.20, 0.20, 0.45, 0.15),
}
TOP_SHARES = (0.05, 0.10, 0.15, 0.20)
SCORE_DIGITS = 9


def weight_scenarios(base=None) -> dict[str, tuple[float, ...]]:
    """Non-negative weights scaled to one: the stated scenarios, then equal weights minus one component each."""
    raw = dict(base or BASE_WEIGHTS)
    for i, name in enumerate(COMPONENTS):
        raw[f"leave_out_{name}"] = tuple(0.0 if j == i else 1.0 for j in range(len(COMPONENTS)))
    out = {}
    for name, w in raw.items():
        if len(w) != len(COMPONENTS) or min(w) < 0 or sum(w) <= 0:
            raise ValueError(f"weights {name}: need {len(COMPONENTS)} non-negative values with a positive sum")
        out[name] = tuple(v / sum(w) for v in w)
    return out


def rank_layers(cells: DataFrame, key: str, layers: dict[str, str], reverse=(), pieces: int | None = None) -> DataFrame:
    """Percentile ranks of several layers: all layers ranked in one pass as (key, layer) rows, then one row per key."""
    long = cells.select(key, F.inline(F.array(*[
        F.struct(F.lit(n).alias("layer"), F.col(c).cast("double").alias("value")) for n, c in layers.items()])))
    r = pct_rank(long, "value", "layer", "pct", pieces=pieces)
    r = r.withColumn("pct", F.when(F.col("layer").isin(list(reverse)), 1.0 - F.col("pct")).otherwise(F.col("pct")))
    return r.groupBy(key).agg(*[F.max(F.when(F.col("layer") == n, F.col("pct"))).alias(n) for n in layers])


def score(heat, elderly, cooling, intensity, weights) -> Column:
    """Weighted sum of rank components on a 0-100 scale."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (heat, elderly, cooling, intensity)]
    w = [F.lit(float(v)) if not isinstance(v, Column) else v for v in weights]
    total = parts[0] * w[0] + parts[1] * w[1] + parts[2] * w[2] + parts[3] * w[3]
    return F.round(F.lit(100.0) * total, SCORE_DIGITS)


def decisions(ranked: DataFrame, key: str, fields: dict[str, str], lenses: dict[str, str], scenarios=None) -> DataFrame:
    """Every cell under every (heat field, weight scenario, population lens), with its score."""
    scenarios = scenarios or weight_scenarios()
    rows = ranked.withColumn("__f", F.explode(F.array(*[
        F.struct(F.lit(n).alias("heat_field"), F.col(c).alias("heat")) for n, c in fields.items()])))
    rows = rows.withColumn("__l", F.explode(F.array(*[
        F.struct(F.lit(n).alias("population_lens"), F.col(c).alias("elderly")) for n, c in lenses.items()])))
    rows = rows.withColumn("__w", F.explode(F.array(*[
        F.struct(F.lit(n).alias("weight_scenario"), *[F.lit(v).alias(f"w{i}") for i, v in enumerate(w)])
        for n, w in scenarios.items()])))
    s = score("__f.heat", "__l.elderly", "cooling", "intensity", [F.col(f"__w.w{i}") for i in range(4)])
    return rows.select(key, "__f.heat_field", "__w.weight_scenario", "__l.population_lens", s.alias("score"))


DECISION = ["heat_field", "weight_scenario", "population_lens"]


def multiverse(scored: DataFrame, key: str, shares=TOP_SHARES, baseline=("gp", "baseline", "qmargin"), pieces: int | None = None) -> DataFrame:
    """Selections of all decisions, each beside the baseline decision's selection of the cell.

    selected and baseline are arrays aligned with shares; `by_share` turns them
    into rows when a report needs it.
    """
    sel = top_shares(scored, "score", shares, key, DECISION, pieces=pieces)
    base = F.lit(True)
    for c, v in zip(DECISION, baseline):
        base = base & (F.col(c) == v)
    return sel.withColumn("baseline", F.max(F.when(base, F.col("selected"))).over(W.partitionBy(key)))


def decision_table(sel: DataFrame, cells: DataFrame, key: str, population: str, shares=TOP_SHARES) -> DataFrame:
    """Per decision and share: size, overlap and Jaccard with the baseline, selected population."""
    s, b = F.col("selected"), F.col("baseline")
    rows = by_share(sel.join(cells.select(key, population), key), shares, "selected", "baseline")
    g = rows.groupBy(*DECISION, "share").agg(
        F.count_if(s).alias("n_selected"), F.count_if(s & b).alias("overlap"), F.count_if(s | b).alias("__u"),
        F.sum(F.when(s, F.col(population)).otherwise(0.0)).alias("selected_population"))
    return g.withColumn("jaccard", safe_div("overlap", "__u")).drop("__u")


def selection_frequency(sel: DataFrame, key: str, baseline=("gp", "baseline", "qmargin"), shares=TOP_SHARES) -> DataFrame:
    """Per cell and share: selection frequency over all decisions and along each dimension."""
    f, w, l = (F.col(c) for c in DECISION)
    bf, bw, bl = baseline
    s = F.col("selected").cast("double")
    freq = lambda cond: F.avg(F.when(cond, s))
    loo = w.startswith("leave_out_")
    return by_share(sel, shares, "selected", "baseline").groupBy(key, "share").agg(
        F.max("baseline").alias("baseline"), F.avg(s).alias("freq_all"),
        freq((f == bf) & (l == bl)).alias("freq_weights"), freq((f == bf) & (w == bw)).alias("freq_lenses"),
        freq((w == bw) & (l == bl)).alias("freq_fields"), freq((f == bf) & (l == bl) & loo).alias("freq_leave_one_out"))


def frequency_summary(freq: DataFrame, scopes=("freq_all", "freq_weights", "freq_lenses", "freq_fields", "freq_leave_one_out")) -> DataFrame:
    """Counts of stable cells per scope and share."""
    long = freq.unpivot(["share", "baseline"], list(scopes), "scope", "f")
    b = F.col("baseline")
    return long.groupBy("scope", "share").agg(
        F.count("*").alias("n_cells"), F.count_if(b).alias("n_baseline"),
        F.count_if(F.col("f") >= 0.8).alias("n_ge_80"), F.count_if(F.col("f") >= 0.9).alias("n_ge_90"),
        F.count_if(F.col("f") >= 1 - 1e-9).alias("n_always"),
        F.count_if(b & (F.col("f") >= 0.8)).alias("n_baseline_ge_80"), F.count_if(b & (F.col("f") >= 0.9)).alias("n_baseline_ge_90"))


def decision_signatures(scored: DataFrame, key: str) -> DataFrame:
    """Order-free signature of each decision's rounded scores, and whether an earlier decision already has it.

    The signature sums md5 digits of (cell, score), so it folds map-side and no
    score vector is gathered.
    """
    sig = scored.groupBy(*DECISION).agg(F.sum(signature_digits(key, F.col("score"))).cast("string").alias("signature"), F.count("*").alias("n"))
    return with_duplicates(sig)


def signature_digits(key: str, value: Column) -> Column:
    text = F.concat_ws(":", F.col(key).cast("string"), F.round(value * 1e6, 0).cast("long").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")


def with_duplicates(sig: DataFrame) -> DataFrame:
    """Whether an earlier decision has the signature already."""
    w = W.partitionBy("signature").orderBy(*DECISION)
    return sig.withColumn("duplicate", F.row_number().over(w) > 1)


def tier_report(df: DataFrame, tier: str, sums: dict[str, str], medians: dict[str, Column], order) -> DataFrame:
    """Cells, sums and given per-tier quantities in a fixed tier order, rounded to two decimals."""
    g = df.groupBy(tier).agg(F.count("*").alias("n_cells"), *[F.round(F.sum(c), 2).alias(n) for n, c in sums.items()],
                             *[F.round(e, 2).alias(n) for n, e in medians.items()])
    rank = F.create_map(*[x for i, t in enumerate(order) for x in (F.lit(t), F.lit(i))])
    return g.withColumn("tier_order", rank[F.col(tier)])
