"""Bootstraps as jobs: draws are rows, statistics are grouped aggregates.

All draws come from the counter generator, so they recompute identically after
the loss of an executor. Tables entering here are folded to nights or clusters
first. Statistics that need more than sums run on a replicate axis (`replicates`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duskline.functions.counter import draw_below, draw_unit
from duskline.functions.numeric import safe_div
from duskline.operators import association as at
from duskline.operators import regression as rg
from duskline.operators import replicates as rp
from duskline.operators.series import guarded_slope
from duskline.session import settled


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def interval(df: DataFrame, col: str, by=(), ps=(0.025, 0.975), need: int | Column = 0, names=("ci_low", "ci_high")) -> DataFrame:
    """Percentile interval over replicates, NULL when fewer than `need` are finite."""
    by = _list(by)
    v = F.when(F.col(col).isNotNull() & ~F.isnan(col), F.col(col))
    q = F.percentile(v, F.array(*[F.lit(float(p)) for p in ps]))
    g = df.groupBy(*by).agg(q.alias("__q"), F.count(v).alias("n_valid"))
    need = F.lit(need) if isinstance(need, int) else need
    return g.select(*by, *[F.when(F.col("n_valid") >= need, F.get("__q", F.lit(i))).alias(nm) for i, nm in enumerate(names)], "n_valid")


def cluster_draws(clusters: DataFrame, cluster: str, reps: int, seed, by=()) -> DataFrame:
    """Per replicate, as many clusters with replacement as there are, as (replicate, cluster, times)."""
    by = _list(by)
    part = by or [F.lit(0)]
    idx = clusters.select(*by, cluster).distinct().withColumns({
        "__i": F.row_number().over(W.partitionBy(*part).orderBy(cluster)) - 1,
        "__k": F.count("*").over(W.partitionBy(*part))})
    slots = idx.select(*by, F.col("__i").alias("__slot"), "__k").withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    slots = slots.withColumn("__i", draw_below("__k", seed, "replicate", "__slot").cast("int"))
    drawn = slots.groupBy(*by, "replicate", "__i").agg(F.count("*").alias("times"))
    return drawn.join(idx.select(*by, "__i", cluster), [*by, "__i"]).select(*by, "replicate", cluster, "times")


def cluster_boot_diff(df: DataFrame, value: str, group: str, hi, lo, cluster: str, reps: int, seed) -> DataFrame:
    """Two-group mean difference with a cluster-bootstrap interval and two-sided p.

    Per-cluster sums and counts suffice, so rows are never resampled.
    """
    rows = df.where(F.col(group).isin(hi, lo) & F.col(value).isNotNull())
    is_hi = F.col(group) == hi
    st = rows.groupBy(cluster).agg(
        F.coalesce(F.sum(F.when(is_hi, F.col(value))), F.lit(0.0)).alias("sh"), F.count_if(is_hi).alias("nh"),
        F.coalesce(F.sum(F.when(~is_hi, F.col(value))), F.lit(0.0)).alias("sl"), F.count_if(~is_hi).alias("nl"))
    d = cluster_draws(st, cluster, reps, seed).join(st, cluster).groupBy("replicate").agg(
        *[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("sh", "nh", "sl", "nl")])
    diff = safe_div("sh", "nh") - safe_div("sl", "nl")
    b = d.select(F.round(diff, 9).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    tail = F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))
    boot = b.where("d IS NOT NULL").agg(
        F.get(q, F.lit(0)).alias("ci_low"), F.get(q, F.lit(1)).alias("ci_high"),
        F.least(F.lit(1.0), F.greatest(2 * tail, 1 / (F.count("*") + 1).cast("double"))).alias("p_boot"), F.count("*").alias("n_valid"))
    obs = st.agg((safe_div(F.sum("sh"), F.sum("nh")) - safe_div(F.sum("sl"), F.sum("nl"))).alias("diff"),
                 F.sum("nh").alias("n_hi"), F.sum("nl").alias("n_lo"))
    o = obs.select(F.struct("diff", "n_hi", "n_lo")).scalar()
    return boot.select(o["diff"].alias("diff"), "ci_low", "ci_high", "p_boot", o["n_hi"].alias("n_hi"), o["n_lo"].alias("n_lo"), "n_valid")


def cluster_boot_mean(df: DataFrame, value: str, cluster: str, by, reps: int, seed) -> DataFrame:
    """Mean per group with a cluster-bootstrap interval, from per-cluster (sum, n)."""
    by = _list(by)
    st = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    d = cluster_draws(st, cluster, reps, seed, by).join(st, [*by, cluster]).groupBy(*by, "replicate").agg(
        (F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("mean"))
    obs = st.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return obs.join(interval(d, "mean", by), by)


def cluster_boot_stat(df: DataFrame, x: str, y: str, cluster: str, reps: int, seed, by=(), stat: str = "rho") -> DataFrame:
    """Rank correlation (stat='rho') or slope (stat='slope') with a cluster-bootstrap interval.

    Drawn rows are re-ranked inside each replicate; a replicate needs more than
    five distinct x. `by` may hold spec columns.
    """
    by = _list(by)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, cluster, x, y)
    weights = lambda d, r, reps_at: rp.key_weights(d, r, reps_at, [cluster])
    one = rp.rank_correlation(x, y, min_n=2, least_x=5) if stat == "rho" else rp.slope(x, y, least_x=5)
    est = rp.apply(rows, cluster_draws(rows, cluster, reps, seed, by), reps, one, by, weights)
    if stat == "rho":
        obs = at.spearman(rows, x, y, by).withColumnRenamed("rho", "estimate")
    else:
        obs = rows.groupBy(*by).agg(guarded_slope(F.col(y), F.col(x)).alias("estimate"), F.count("*").alias("n"))
    ci = interval(est, "est", by)
    if by:
        return obs.join(ci, by)
    s = ci.select(F.struct("ci_low", "ci_high", "n_valid")).scalar()
    return obs.withColumns({k: s[k] for k in ("ci_low", "ci_high", "n_valid")})


def block_starts(spine: DataFrame, reps: int, seed, length: int | Column = 14, by=(), year: str = "year") -> DataFrame:
    """Calendar moving blocks: per replicate and season, days drawn in blocks that never wrap or cross seasons.

    spine has one row per calendar day with its season and day_index. Returns
    (by, replicate, season, start, take): `take` days from day_index `start`.
    """
    by = _list(by)
    length = F.lit(length) if isinstance(length, int) else length
    seasons = spine.groupBy(*by, year).agg(F.count("*").alias("__n"))
    seasons = seasons.withColumn("__L", F.least(length, F.col("__n")))
    b = seasons.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    b = b.withColumn("__j", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("__n") / F.col("__L")) - 1).cast("int"))))
    start = draw_below(F.col("__n") - F.col("__L") + 1, seed, "replicate", year, "__j").cast("int")
    take = F.least(F.col("__L"), F.col("__n") - F.col("__j") * F.col("__L")).cast("int")
    return b.select(*by, "replicate", year, start.alias("start"), take.alias("take"))


def block_draws(spine: DataFrame, reps: int, seed, length: int | Column = 14, by=(), year: str = "year") -> DataFrame:
    """The days of `block_starts` as (by, replicate, season, day_index, times)."""
    by = _list(by)
    b = block_starts(spine, reps, seed, length, by, year)
    b = b.withColumn("day_index", F.explode(F.sequence("start", F.col("start") + F.col("take") - 1)))
    return b.groupBy(*by, "replicate", year, "day_index").agg(F.count("*").alias("times"))


def block_boot(
    cal: DataFrame, x: str, y: str, flag: Column, reps: int, seed, length: int | Column = 14, covs=(), raw=(), by=(), min_n: int = 8
) -> DataFrame:
    """(Partial) rank correlation of flagged nights with a moving-block interval.

    Blocks are drawn over the complete calendar; the flag selects nights inside
    each replicate. The interval needs max(20, reps / 2) finite replicates.
    """
    by = _list(by)
    keep = cal.where(flag).select(*by, "year", "day_index", x, y, *covs).na.drop(subset=[x, y, *covs])
    est = rp.apply(keep, block_starts(cal, reps, seed, length, by), reps, rp.rank_correlation(x, y, covs, raw, min_n), by)
    obs = at.partial_spearman(keep, x, y, covs, by, min_n, raw=raw)
    ci = interval(est, "est", by, need=max(20, reps // 2))
    return obs.join(ci, by, "left")


def block_boot_curve(
    cal: DataFrame, prof: DataFrame, label: str, x: str, y: str, reps: int, seed, length: int = 14
) -> DataFrame:
    """Mean curve per label with moving-block bands: replicate means of y at every x, null-skipping.

    cal carries the label of each night; prof is long (night_date, x, y). A night
    is one row with its values at every x; a replicate is a weight per night.
    """
    nights = cal.where(F.col(label).isNotNull()).select("year", "day_index", "night_date", label)
    rows = prof.where(F.col(y).isNotNull()).select("night_date", F.col(x).cast("double").alias(x), y).join(nights, "night_date")
    places = [r[0] for r in rows.select(x).distinct().orderBy(x).collect()]  # offsets of a profile
    labels = [r[0] for r in nights.select(label).distinct().collect()]  # a few
    names = [f"p{i}" for i in range(len(places))]
    wide = rows.groupBy("year", "day_index", label).agg(*[F.avg(F.when(F.col(x) == p, F.col(y))).alias(n) for p, n in zip(places, names, strict=True)])
    draws = block_starts(cal, reps, seed, length).withColumn(label, F.explode(F.array(*[F.lit(v) for v in labels])))
    b = rp.apply(wide, draws, reps, rp.mean_columns(names), [label], many=names)
    at_x = F.array(*[F.lit(p) for p in places])
    b = b.withColumn(x, F.get(at_x, F.substring("name", 2, 9).cast("int")))
    obs = rows.groupBy(label, x).agg(F.avg(y).alias("mean"), F.count("*").alias("n_nights"))
    return obs.join(interval(b, "est", [label, x]), [label, x])


def block_boot_ols(cal: DataFrame, y: str, xs, reps: int, seed, length: int = 14, by=()) -> DataFrame:
    """Multi-predictor OLS with moving-block intervals per coefficient."""
    by, xs = _list(by), list(xs)
    ok = cal.na.drop(subset=[*xs, y]).select(*by, "year", "day_index", y, *xs)
    design = [F.lit(1.0), *[F.col(v).cast("double") for v in [*xs, y]]]
    pairs = [(i, j) for i in range(len(design)) for j in range(i, len(design))]
    names = [f"s{i}_{j}" for i, j in pairs]
    per = ok.groupBy(*by, "year", "day_index").agg(*[F.sum(design[i] * design[j]).alias(n) for (i, j), n in zip(pairs, names, strict=True)])
    terms = ["intercept", *xs]

    def fitted(total: np.ndarray) -> np.ndarray:
        return np.where(total[0] >= len(xs) + 6, rp.least_squares(total), np.nan)

    est = rp.apply_sums(per, names, block_starts(cal, reps, seed, length, by), reps, fitted, terms, by).withColumnRenamed("name", "term")
    o = rg.fit(ok, y, xs, by)
    obs = o.select(*by, "n", F.inline(F.arrays_zip(F.array(*[F.lit(t) for t in terms]).alias("term"), F.col("f.beta").alias("estimate"))))
    return obs.join(interval(est, "est", [*by, "term"]), [*by, "term"])


def block_boot_spline(
    cal: DataFrame, curve: DataFrame, t: str, warmth: str, y: str, knots, levels: dict[str, Column], grid, reps: int, seed, length: int = 14
) -> DataFrame:
    """Spline curves at given warmth levels with pointwise moving-block bands.

    Cross products are summed once per night; a replicate adds weighted nights.
    """
    basis = rg.natural_spline(t, knots)
    w0 = F.col(warmth)
    design = [F.lit(1.0), *basis, w0, *[b * w0 for b in basis], F.col(y)]
    k = len(design)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    named = curve.select("night_date", *[d.cast("double").alias(f"d{i}") for i, d in enumerate(design)])
    per = named.groupBy("night_date").agg(*[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    names = [f"s{i}_{j}" for i, j in pairs]
    per = per.join(cal.select("year", "day_index", "night_date"), "night_date")
    gb = rg.natural_spline("t", knots)
    at_grid = [F.struct(F.lit(nm).alias("level"), F.lit(float(g)).alias("t"), v.cast("double").alias("w")) for nm, v in levels.items() for g in grid]
    row = cal.sparkSession.range(1).select(F.explode(F.array(*at_grid)).alias("p")).select("p.*")
    w = F.col("w")
    points = row.select("level", "t", F.array(F.lit(1.0), *gb, w, *[g * w for g in gb]).alias("x")).collect()  # levels x grid rows
    basis_at, keys = np.array([p["x"] for p in points], float), [f"{p['level']}@{i}" for i, p in enumerate(points)]

    def fitted(total: np.ndarray) -> np.ndarray:
        return basis_at @ rp.least_squares(total)

    est = rp.apply_sums(per, names, block_starts(cal, reps, seed, length), reps, fitted, keys)
    est = est.select(F.substring_index("name", "@", 1).alias("level"), F.get(F.array(*[F.lit(float(p["t"])) for p in points]), F.substring_index("name", "@", -1).cast("int")).alias("t"), "est")
    whole = np.array(per.agg(*[F.sum(n) for n in names]).first(), float)
    fit = fitted(whole[:, None])[:, 0].tolist()
    obs = cal.sparkSession.createDataFrame([(p["level"], float(p["t"]), f) for p, f in zip(points, fit, strict=True)], "level string, t double, fit double")
    return obs.join(interval(est, "est", ["level", "t"], need=reps), ["level", "t"])


def stationary_draws(series: DataFrame, reps: int, seed, restart: float = 1 / 14, by=(), year: str = "year") -> DataFrame:
    """Stationary bootstrap positions: geometric blocks, circular inside each season.

    series has one row per observation with its season and 0-based position.
    """
    by = _list(by)
    n = F.count("*").over(W.partitionBy(*by, year))
    b = series.select(*by, year, "position", n.alias("__n")).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    fresh = (F.col("position") == 0) | (draw_unit(f"{seed}r", "replicate", year, "position") < restart)
    w = W.partitionBy(*by, year, "replicate").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("__from", F.last(F.when(fresh, F.col("position")), ignorenulls=True).over(w))
    start = draw_below("__n", f"{seed}s", "replicate", year, "__from")
    return b.select(*by, year, "replicate", F.pmod(start + F.col("position") - F.col("__from"), F.col("__n")).cast("int").alias("position"))


def stationary_boot(df: DataFrame, x: str, y: str, order: str, reps: int, seed, by=(), year: str = "year", restart: float = 1 / 14) -> DataFrame:
    """Rank correlation with a stationary-bootstrap interval."""
    by = _list(by)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn(
        "position", F.row_number().over(W.partitionBy(*by, year).orderBy(order)) - 1)
    rows = rows.select(*by, year, "position", x, y)
    d = stationary_draws(rows, reps, seed, restart, by, year).groupBy(*by, "replicate", year, "position").agg(F.count("*").alias("times"))
    weights = lambda drawn, r, at_reps: rp.key_weights(drawn, r, at_reps, [year, "position"])
    ci = interval(rp.apply(rows, d, reps, rp.rank_correlation(x, y), by, weights), "est", by)
    obs = at.spearman(rows, x, y, by)
    return obs.join(ci, by)


def _block_counts(df: DataFrame, col: str, block: str, labels: list, pieces: int | None = None) -> DataFrame:
    """Distinct values of a column with an array over blocks: how many rows of each block lie below, and half of those tied with it.

    As `cumulative_counts`: ties are folded map-side, values are cut into ranges,
    ranges are scanned in parallel and tied together by their totals.
    """
    pieces = pieces or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"__n{i}" for i in range(len(labels))]
    freq = df.groupBy(F.col(col).alias("value")).agg(*[F.count_if(F.col(block) == b).alias(n) for b, n in zip(labels, names, strict=True)])
    cuts = df.agg(F.percentile_approx(col, [i / pieces for i in range(1, pieces)], 1000)).scalar()
    cut = freq.withColumn("__cuts", cuts).withColumn("__piece", F.size(F.filter("__cuts", lambda e: e < F.col("value")))).drop("__cuts")
    inside = W.partitionBy("__piece").orderBy("value")
    run = cut.select("value", "__piece", *names, *[(F.sum(n).over(inside) - F.col(n)).alias(f"__b{n}") for n in names])
    over = W.partitionBy(F.lit(0)).orderBy("__piece")
    sums = cut.groupBy("__piece").agg(*[F.sum(n).alias(n) for n in names])
    sums = sums.select("__piece", *[(F.sum(n).over(over) - F.col(n)).alias(f"__p{n}") for n in names])
    place = F.array(*[F.col(f"__b{n}") + F.col(f"__p{n}") + F.col(n) / 2 for n in names])
    return run.join(sums, "__piece").select("value", place.alias("place"))


def block_rank_correlations(df: DataFrame, x: str, y: str, block: str, reps: int, seed, raw=(), pieces: int | None = None) -> DataFrame:
    """replicate (-1: the data), rho, partial and n: rank correlation when whole blocks are drawn with replacement, and the same after `raw` columns are taken off both ranks.

    With multiplicities w of the blocks, a cell's rank in a replicate is
    sum(w * place) + 1/2, place being its counts by block. Sums of products of ranks are
    therefore polynomials in w; their coefficients, arrays over two or three blocks, are
    added up in one pass over the cells, and every replicate is an evaluation. Neither rows nor
    ranks are made per replicate. Blocks are few.
    """
    raw = list(raw)
    rows = settled(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).na.drop(subset=raw or None).select(block, x, y, *raw))
    labels = sorted(r[0] for r in rows.select(block).distinct().collect())
    b = len(labels)
    for v, r in ((x, "__px"), (y, "__py")):
        rows = rows.join(_block_counts(rows.select(block, x, y), v, block, labels, pieces).select(F.col("value").alias(v), F.col("place").alias(r)), v)
    index = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(block)).cast("int") - 1
    k = len(raw)
    rows = rows.select(index.alias("b"), "__px", "__py", *[F.col(c).cast("double").alias(f"__r{i}") for i, c in enumerate(raw)])
    size = b + 3 * b**3 + 2 * b * b + 2 * k * b * b + k * b + k * k * b

    def sums(batches):
        total = np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.asarray(batch["b"])
            px, py = (np.stack(batch[c].to_numpy(zero_copy_only=False)).astype(float) for c in ("__px", "__py"))
            z = np.column_stack([np.asarray(batch[f"__r{i}"], float) for i in range(k)]) if k else np.zeros((len(at), 0))
            out = []
            for i in range(b):
                m = at == i
                u, v, r = px[m], py[m], z[m]
                out.append(np.concatenate([[m.sum()], (u.T @ u).ravel(), (v.T @ v).ravel(), (u.T @ v).ravel(), u.sum(0), v.sum(0), (r.T @ u).ravel(), (r.T @ v).ravel(), r.sum(0), (r.T @ r).ravel()]))
            total += np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    got = rows.mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    parts = np.array([r["v"] for r in got]).reshape(b, -1)
    cut = np.cumsum([1, b * b, b * b, b * b, b, b, k * b, k * b, k, k * k])
    n, uu, vv, uv, u1, v1, ru, rv, r1, rr = np.split(parts, cut[:-1], axis=1)

    @F.pandas_udf("rho double, partial double, n long")
    def evaluate(weights: pd.Series) -> pd.DataFrame:
        w = np.stack(weights.to_numpy()).astype(float)
        two = lambda m: np.einsum("ri,ijk,rj,rk->r", w, m.reshape(b, b, b), w, w)
        one = lambda m: np.einsum("ri,ij,rj->r", w, m, w)
        total = w @ n[:, 0]
        # ranks are place sums and a half
        sx, sy = one(u1) + total / 2, one(v1) + total / 2
        xx, yy, xy = two(uu) + one(u1) + total / 4, two(vv) + one(v1) + total / 4, two(uv) + (one(u1) + one(v1)) / 2 + total / 4
        cov = np.zeros((len(w), k + 2, k + 2))
        cov[:, 0, 0], cov[:, 1, 1], cov[:, 0, 1] = total * xx - sx * sx, total * yy - sy * sy, total * xy - sx * sy
        cov[:, 1, 0] = cov[:, 0, 1]
        for i in range(k):
            si = w @ r1[:, i]
            for at, m, s in ((0, ru, sx), (1, rv, sy)):
                cross = np.einsum("ri,ij,rj->r", w, m.reshape(b, k, b)[:, i], w) + si / 2
                cov[:, i + 2, at] = cov[:, at, i + 2] = total * cross - si * s
            for j in range(k):
                cov[:, i + 2, j + 2] = total * (w @ rr.reshape(b, k, k)[:, i, j]) - si * (w @ r1[:, j])
        return pd.DataFrame({"rho": rp.swept_correlation(cov[:, :2, :2], 3, total), "partial": rp.swept_correlation(cov, 3, total), "n": total.astype(np.int64)})

    drawn = cluster_draws(rows.select(F.get(F.array(*[F.lit(v) for v in labels]), F.col("b")).alias(block)).distinct(), block, reps, seed)
    vector = F.array(*[F.coalesce(F.sum(F.when(F.col(block) == v, F.col("times"))), F.lit(0)).cast("double") for v in labels])
    weights = drawn.groupBy("replicate").agg(vector.alias("w")).unionByName(
        df.sparkSession.range(1).select(F.lit(-1).alias("replicate"), F.array(*[F.lit(1.0)] * b).alias("w")))
    out = weights.select("replicate", evaluate("w").alias("e")).select("replicate", "e.*")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("rho", "partial")})
