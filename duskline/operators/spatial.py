"""Spatial operators: nearest neighbours, inverse distance, fixed effects, fields, cross-validation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.functions.numeric import safe_div
from duskline.operators.neighbours import nearest  # noqa: F401  a spatial operator like the others
from duskline.session import settled


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# --- inverse distance ---------------------------------------------------------

#: Squared distance of an exact hit.
HIT = 1e-18


#: Stations of one block; distances held at once.
STATION_BLOCK, HELD = 1 << 16, 1 << 17


def _dealt(df: DataFrame, key: str, block: str, per_block: int, least: int = 1) -> tuple[DataFrame, int]:
    """Rows with the number of their block, dealt by a hash of their key, and the number of blocks."""
    n = df.count()
    many = max(1, math.ceil(n / per_block), min(least, n // 512))
    return df.withColumn(block, F.pmod(F.xxhash64(key), F.lit(many)).cast("int")), many


def _floats(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table[n].to_numpy(), float) for n in names]


def _partial_sums(power: float):
    """Sums of one block of cells over one block of stations, a strip of cells at a time."""

    def run(cells: pa.Table, stations: pa.Table) -> pa.Table:
        stations = stations.sort_by("id")
        cx, cy = _floats(cells, "x", "y")
        x, y, v = _floats(stations, "x", "y", "v")
        w, wv, hit = np.zeros(len(cx)), np.zeros(len(cx)), np.full(len(cx), -1)
        step = max(1, HELD // max(1, len(x)))
        for lo in range(0, len(cx) if len(x) else 0, step):
            cut = slice(lo, lo + step)
            d2 = (x - cx[cut, None]) ** 2
            d2 += (y - cy[cut, None]) ** 2
            at = np.flatnonzero(d2.min(axis=1) <= HIT)
            hit[lo + at] = (d2[at] <= HIT).argmax(axis=1)  # of the lowest key
            np.maximum(d2, HIT, out=d2)
            weight = np.reciprocal(d2, out=d2) if power == 2.0 else d2 ** (-power / 2)
            w[cut], wv[cut] = weight.sum(axis=1), weight @ v
        none = pa.array(np.maximum(hit, 0), mask=hit < 0)
        found = [stations[n].combine_chunks().take(none) for n in ("id", "v")]
        return pa.table([cells["id"], pa.array(w), pa.array(wv), *found], names=["id", "w", "wv", "hit_id", "hit_v"])

    return run


def idw(cells: DataFrame, key: str, cell_xy, stations: DataFrame, station_key: str, station_xy, value: str, power: float = 2.0, per_tile: int = 8192) -> DataFrame:
    """Inverse-distance weighting from all stations; an exact hit takes the value of the station with the lowest key.

    Cells are dealt into blocks of per_tile, stations into blocks of STATION_BLOCK. One task meets one
    block of each, so what it holds does not grow with the tables; a station is copied once per block of
    cells, a cell once per block of stations, and a cell leaves with a row per block of stations.
    Cells without coordinates get NULL; stations without coordinates or value take no part.
    """
    x, y = (F.col(c).cast("double") for c in cell_xy)
    sx, sy = (F.col(c).cast("double") for c in station_xy)
    c, many = _dealt(cells.where(x.isNotNull() & y.isNotNull()).select(F.col(key).alias("id"), x.alias("x"), y.alias("y")), "id", "cb", per_tile, cells.sparkSession.sparkContext.defaultParallelism)
    known = stations.where(sx.isNotNull() & sy.isNotNull() & F.col(value).isNotNull())
    s, parts = _dealt(known.select(F.col(station_key).alias("id"), sx.alias("x"), sy.alias("y"), F.col(value).cast("double").alias("v")), "id", "sb", STATION_BLOCK)
    c = c.withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    s = s.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    dbl = T.DoubleType()
    schema = T.StructType([T.StructField("id", cells.schema[key].dataType), T.StructField("w", dbl), T.StructField("wv", dbl),
                           T.StructField("hit_id", stations.schema[station_key].dataType), T.StructField("hit_v", dbl)])
    part = c.groupBy("cb", "sb").cogroup(s.groupBy("cb", "sb")).applyInArrow(_partial_sums(power), schema)
    hit = F.min(F.when(F.col("hit_id").isNotNull(), F.struct("hit_id", "hit_v")))["hit_v"]
    total = part.groupBy(F.col("id").alias(key)).agg(F.coalesce(hit, F.sum("wv") / F.sum("w")).alias("idw"))
    return cells.select(F.col(key).alias(key)).join(total, key, "left")


# --- panel model -------------------------------------------------------------


def panel_components(cells: DataFrame, unit: str, time: str, by=()) -> DataFrame:
    """by, unit, component: the lowest unit that is connected with it through common times.

    Every unit takes the lowest name among the units it meets, then the name of
    that name, until none changes.
    """
    by = _list(by)
    edges = cells.select(*by, unit, time)
    now = settled(edges.select(*by, unit).distinct().withColumn("component", F.col(unit)))
    while True:
        low_t = edges.join(now, [*by, unit]).groupBy(*by, time).agg(F.min("component").alias("__low"))
        low_u = edges.join(low_t, [*by, time]).groupBy(*by, unit).agg(F.min("__low").alias("__low"))
        names = now.select(*by, F.col(unit).alias("__low"), F.col("component").alias("__name"))
        new = settled(now.join(low_u, [*by, unit]).join(names, [*by, "__low"]).select(*by, unit, F.least("__name", "__low").alias("component"), (F.least("__name", "__low") != F.col("component")).alias("__moved")))
        if new.where("__moved").isEmpty():
            return now
        now = new.drop("__moved")


def two_way_effects(panel: DataFrame, unit: str, time: str, y: str, by=(), tol: float = 1e-12, max_rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """Unbalanced additive model y = unit + time + error by conjugate gradients on the normal equations.

    Returns (unit effects, time effects), both with their `component`: units that
    no chain of common times connects are not comparable, so every component of
    the unit-time graph has unit effects of mean zero and time effects that keep
    its scale. Time effects are eliminated; one round is one product with the
    panel's counts and one settled table of the size of the units, for all groups
    `by` at once. It ends when no unit moved by more than `tol` of the spread of y
    in its component.
    """
    by = _list(by)
    cells = settled(panel.where(F.col(y).isNotNull()).groupBy(*by, unit, time).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s")))
    group = [*by, "component"]
    units = panel_components(cells, unit, time, by)
    cells = settled(cells.join(units, [*by, unit]))
    level = cells.groupBy(*group).agg((F.sum("s") / F.sum("n")).alias("__level"))
    cells = cells.join(level, group).withColumn("s", F.col("s") - F.col("n") * F.col("__level")).drop("__level")

    def over_times(value: Column, state: DataFrame | None = None) -> DataFrame:
        """Sum over a unit's rows of the mean, at that time, of `value` per row."""
        rows = cells if state is None else cells.join(state, [*group, unit])
        mean = rows.groupBy(*group, time).agg((F.sum(value) / F.sum("n")).alias("__m"))
        return cells.join(mean, [*group, time]).groupBy(*group, unit).agg(F.sum(F.col("n") * F.col("__m")).alias("__t"))

    own = cells.groupBy(*group, unit).agg(F.sum("n").alias("d"), F.sum("s").alias("__s"))
    start = own.join(over_times(F.col("s")), [*group, unit]).select(*group, unit, "d", F.lit(0.0).alias("x"), (F.col("__s") - F.col("__t")).alias("r"))
    state = settled(start.withColumn("p", F.col("r") / F.col("d")))
    scale = settled(cells.groupBy(*group).agg(F.greatest(F.max(F.abs(F.col("s") / F.col("n"))), F.lit(1e-300)).alias("__scale")))
    for _ in range(max_rounds):
        ap = state.join(over_times(F.col("n") * F.col("p"), state.select(*group, unit, "p")), [*group, unit]).withColumn("ap", F.col("d") * F.col("p") - F.col("__t")).drop("__t")
        ap = settled(ap)
        dot = lambda a, b: F.sum(F.col(a) * F.col(b))
        sums = ap.groupBy(*group).agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz"), dot("p", "ap").alias("pap"),
                                      F.sum(F.col("r") * F.col("ap") / F.col("d")).alias("ra"), F.sum(F.col("ap") * F.col("ap") / F.col("d")).alias("aa"))
        step = F.when(F.col("pap") > 0, F.col("rz") / F.col("pap")).otherwise(F.lit(0.0))
        sums = sums.withColumn("__step", step)
        left = F.greatest(F.lit(0.0), F.col("rz") - 2 * F.col("__step") * F.col("ra") + F.col("__step") * F.col("__step") * F.col("aa"))
        sums = settled(sums.select(*group, "__step", F.when(F.col("rz") > 0, left / F.col("rz")).otherwise(F.lit(0.0)).alias("__turn")))
        new = ap.join(sums, group).withColumns({"x": F.col("x") + F.col("__step") * F.col("p"), "r": F.col("r") - F.col("__step") * F.col("ap")})
        moved = new.join(scale, group).agg(F.max(F.abs(F.col("__step") * F.col("p")) / F.col("__scale"))).first()[0]
        state = new.withColumn("p", F.col("r") / F.col("d") + F.col("__turn") * F.col("p")).select(*group, unit, "d", "x", "r", "p")
        if moved is None or moved <= tol:
            break
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    shift = state.groupBy(*group).agg(F.avg("x").alias("__mean"))
    found = settled(state.join(shift, group).select(*group, unit, (F.col("x") - F.col("__mean")).alias("unit_effect")))
    times = cells.join(found, [*group, unit]).groupBy(*group, time).agg((F.sum(F.col("s") - F.col("n") * F.col("unit_effect")) / F.sum("n")).alias("__g"))
    times = settled(times.join(level, group).select(*group, time, (F.col("__g") + F.col("__level")).alias("time_effect")))
    return found, times


def effect_targets(panel: DataFrame, units: DataFrame, times: DataFrame, unit: str, time: str, y: str, year: str) -> DataFrame:
    """Coverage-adjusted target per unit, with the standard error of its annual means and residual RMSE.

    Targets of different components of the panel are not comparable.
    """
    base = times.agg(F.avg("time_effect")).scalar()
    j = panel.where(F.col(y).isNotNull()).join(units, unit).join(times, [time, "component"])
    j = j.withColumn("__o", F.col(y) - F.col("time_effect"))
    annual = j.groupBy(unit, year).agg(F.avg("__o").alias("__a")).groupBy(unit).agg(
        F.count("*").alias("n_years"), safe_div(F.stddev_samp("__a"), F.sqrt(F.count("*").cast("double"))).alias("__se"))
    e = F.col("__o") - F.col("unit_effect")
    main = j.groupBy(unit).agg(
        F.count("*").alias("n_nights"), F.avg(y).alias("raw_mean"), F.first("unit_effect").alias("unit_effect"),
        F.sqrt(F.avg(e * e)).alias("residual_rmse"))
    out = main.join(annual, unit).withColumn("adjusted_mean", F.col("unit_effect") + base)
    from duskline.operators.ranks import exact_quantiles

    out = settled(out)
    middle = exact_quantiles(out, [], "__se", [0.5]).select("quantile")
    fallback = middle.agg(F.max("quantile")).scalar()
    return out.withColumns({"target_se": F.coalesce("__se", fallback), "se_imputed": F.col("__se").isNull()}).drop("__se")


def fold_targets(panel: DataFrame, units: DataFrame | None, times: DataFrame, unit: str, time: str, y: str, year: str, by) -> DataFrame:
    """by, unit, target, se: coverage-adjusted targets of each fold, on the fold's mean time effect.

    units: effects of the training units; None for held-out units, whose target
    is their mean after taking off the training fold's time effects. A unit of one
    year gets the fold's mean standard error.
    """
    by = _list(by)
    base = times.groupBy(*by).agg(F.avg("time_effect").alias("__base"))
    j = panel.where(F.col(y).isNotNull()).join(times.drop("component"), [*by, time]).withColumn("__o", F.col(y) - F.col("time_effect"))
    annual = j.groupBy(*by, unit, year).agg(F.avg("__o").alias("__a"), F.sum("__o").alias("__s"), F.count("*").alias("__n")).groupBy(*by, unit).agg(
        safe_div(F.stddev_samp("__a"), F.sqrt(F.count("*").cast("double"))).alias("__se"), (F.sum("__s") / F.sum("__n")).alias("__own"))
    found = annual if units is None else annual.join(units.drop("component"), [*by, unit]).withColumn("__own", F.col("unit_effect"))
    usual = annual.groupBy(*by).agg(F.avg("__se").alias("__usual"))
    return found.join(base, by).join(usual, by).select(*by, unit, (F.col("__own") + F.col("__base")).alias("target"), F.coalesce("__se", "__usual").alias("se"))


def anomaly_targets(df: DataFrame, unit: str, night: str, anomaly: str) -> DataFrame:
    """Mean anomaly per unit over its nights, with the between-night standard error."""
    per = df.groupBy(unit, night).agg(F.avg(anomaly).alias("__a"))
    return per.groupBy(unit).agg(F.avg("__a").alias("target"), F.stddev_samp("__a").alias("sd"), F.count("*").alias("n")).withColumn(
        "se", safe_div("sd", F.sqrt(F.col("n").cast("double"))))


# --- partitions --------------------------------------------------------------


def quantile_blocks(df: DataFrame, x: str, y: str, nx: int = 3, ny: int = 3, out: str = "block", pieces: int | None = None) -> DataFrame:
    """Spatial blocks from quantile cuts of both coordinates."""
    from duskline.operators.ranks import qcut

    d = qcut(df, x, nx, out="__bx", pieces=pieces)
    d = qcut(d, y, ny, out="__by", pieces=pieces)
    return d.withColumn(out, F.col("__bx") * ny + F.col("__by")).drop("__bx", "__by")


def kmeans_partitions(stations: DataFrame, key: str, x: str, y: str, repeats: int, blocks: int, seed: int | str, rounds: int = 20) -> DataFrame:
    """Repeated K-means partitions of standardised coordinates: (repeat, key, block).

    All repeats move together: one Lloyd round assigns every station in all
    repeats from one array of centres (repeats x blocks, a bound set by the
    parameters) and folds sums by (repeat, centre) map-side. Starts are the
    stations with the lowest counter draws of the repeat; a centre without
    stations stays. Squared distances are rounded to nine digits, ties go to
    the lower centre.
    """
    from duskline.functions.counter import draw_int

    live = stations.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    m = live.agg(*[f(c).alias(f"{n}{c}") for c in ("__x", "__y") for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = [(F.col(c) - F.lit(m[f"m{c}"])) / F.lit(m[f"s{c}"] or 1.0) for c in ("__x", "__y")]
    pts = settled(live.select(key, *[F.round(e, 12).alias(c) for e, c in zip(z, ("zx", "zy"), strict=True)]))
    drawn = pts.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("draw", draw_int(seed, "repeat", key))
    first = drawn.withColumn("at", F.row_number().over(W.partitionBy("repeat").orderBy("draw", key))).where(F.col("at") <= blocks)
    centres = np.full((repeats, blocks, 2), np.nan)
    for r in first.select("repeat", "at", "zx", "zy").collect():  # repeats x blocks rows
        centres[r["repeat"], r["at"] - 1] = r["zx"], r["zy"]

    def labelled(df: DataFrame) -> DataFrame:
        table = F.lit([[float(v) for c in rep for v in c] for rep in centres])
        far = lambda rep, j: F.round((F.col("zx") - rep[2 * j]) * (F.col("zx") - rep[2 * j]) + (F.col("zy") - rep[2 * j + 1]) * (F.col("zy") - rep[2 * j + 1]), 9)
        pick = lambda rep: F.array_min(F.array(*[F.struct(far(rep, j).alias("d"), F.lit(j).alias("j")) for j in range(blocks)]))["j"]
        return df.select(key, "zx", "zy", F.posexplode(F.transform(table, pick)).alias("repeat", "block"))

    for _ in range(rounds):
        sums = labelled(pts).groupBy("repeat", "block").agg(F.avg("zx").alias("cx"), F.avg("zy").alias("cy")).collect()  # repeats x blocks rows
        new = centres.copy()
        for r in sums:
            new[r["repeat"], r["block"]] = r["cx"], r["cy"]
        if np.allclose(new, centres, rtol=0, atol=1e-12, equal_nan=True):
            break
        centres = new
    return labelled(pts).select("repeat", key, "block")


def partition_signature(df: DataFrame, key: str, label: str, by=()) -> DataFrame:
    """Signature of a partition that does not depend on its labels.

    Every block is named by its lowest member; the signature sums md5 digits of
    (member, block name), so it folds map-side.
    """
    by = _list(by)
    named = df.groupBy(*by, label).agg(F.min(key).alias("__name"))
    j = df.join(named, [*by, label])
    text = F.concat_ws(":", F.col(key).cast("string"), F.col("__name").cast("string"))
    digits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return j.groupBy(*by).agg(F.sum(digits).cast("string").alias("signature"), F.count("*").alias("n"))


# --- ridge with leave-one-out choice of alpha --------------------------------


def ridge_alphas() -> list[float]:
    return [float(a) for a in np.logspace(-2, 3, 30)]


class _Fold:
    """Eigenbasis of the standardised training moments of one model, from packed sums; predictors that are dropped are swept out."""

    def __init__(self, n: float, sums: np.ndarray, cross: np.ndarray, use: list[int]):
        k = len(sums) - 1
        mean = sums / n
        cov = cross / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[use], 0))
        self.n, self.use = n, use
        self.mean, self.sd, self.level = mean[use], np.where(sd > 1e-12, sd, 1.0), mean[k]
        self.roots, self.basis = np.linalg.eigh(cov[np.ix_(use, use)] / np.outer(self.sd, self.sd) * n)
        self.pull = self.basis.T @ (cov[use, k] / self.sd * n)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.use] - self.mean) / self.sd @ self.basis

    def loo(self, x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> np.ndarray:
        """Sum of squared leave-one-out errors for every alpha."""
        u, shrunk = self.turned(x), 1 / (self.roots[:, None] + alphas)
        e = (y - self.level)[:, None] - u @ (self.pull[:, None] * shrunk)
        return ((e / (1 - 1 / self.n - (u * u) @ shrunk)) ** 2).sum(0)

    def coefficients(self, alpha: float) -> np.ndarray:
        """On standardised predictors."""
        return self.basis @ (self.pull / (self.roots + alpha))

    def predict(self, x: np.ndarray, alpha: float) -> np.ndarray:
        return self.level + (x[:, self.use] - self.mean) / self.sd @ self.coefficients(alpha)


def _matrix(b, names) -> np.ndarray:
    return np.column_stack([np.asarray(b[n].to_numpy(zero_copy_only=False), float) for n in names])


@dataclass(frozen=True)
class RidgeStudy:
    """Fitted folds of `ridge_study`: predictions and coefficients as tables, both with `dropped` (None: all predictors)."""

    predictions: DataFrame
    coefficients: DataFrame


def ridge_study(df: DataFrame, key: str, y: str, xs, folds: DataFrame, alphas=None, drop: bool = False, least: int = 10) -> RidgeStudy:
    """Blocked ridge predictions: scaling and alpha (by exact leave-one-out error) are learnt in each training fold.

    folds: (repeat, key, block). One aggregate gives the moments of every
    (repeat, block); those of a training fold are the repeat's less the block's, and with
    `drop` every model that leaves out one predictor takes part of the same
    moments. One pass over the rows adds up the leave-one-out errors of all
    models, folds and alphas in arrays; a second one predicts. A row is never
    copied per fold, model or alpha. What reaches the driver is of a size set
    by models x repeats x blocks.
    """
    xs, alphas = list(xs), np.array(ridge_alphas() if alphas is None else [float(a) for a in alphas])
    k = len(xs)
    places = folds.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("repeat").cast("int").alias("r"), F.col("block").cast("int").alias("b")))).alias("__folds"))
    full = df.na.drop(subset=[*xs, y]).select(F.col(key).alias("__key"), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate([*xs, y])])
    shift = full.agg(*[F.avg(f"__{i}") for i in range(k + 1)]).first()
    cols = [f"__{i}" for i in range(k + 1)]
    rows = settled(full.withColumns({c: F.col(c) - F.lit(m or 0.0) for c, m in zip(cols, shift, strict=True)}).join(places, "__key"))
    products = {(i, j): F.sum(F.col(cols[i]) * F.col(cols[j])) for i in range(k + 1) for j in range(i, k + 1)}
    sums = rows.select(*cols, F.explode("__folds").alias("repeat", "block")).groupBy("repeat", "block").agg(
        F.count("*").alias("n"), F.array(*[F.sum(c) for c in cols]).alias("s"), F.array(*products.values()).alias("p")).collect()
    packed: dict[int, dict[int, tuple]] = {}
    for r in sums:
        cross = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(products, r["p"], strict=True):
            cross[i, j] = cross[j, i] = v
        packed.setdefault(r["repeat"], {})[r["block"]] = (float(r["n"]), np.array(r["s"]), cross)
    models = [(None, list(range(k))), *([(x, [j for j in range(k) if j != i]) for i, x in enumerate(xs)] if drop and k > 1 else [])]
    fits: dict[tuple, _Fold] = {}
    for repeat, blocks in packed.items():
        total = [sum(b[i] for b in blocks.values()) for i in range(3)]
        for block, own in blocks.items():
            n, s, c = (t - o for t, o in zip(total, own, strict=True))
            if n >= least:
                for at, (_, use) in enumerate(models):
                    fits[at, repeat, block] = _Fold(n, s, c, use)

    def errors(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b, cols)
            where = [dict(f) for f in b["__folds"].to_pylist()]
            label = {r: np.array([w.get(r, -1) for w in where]) for r in packed}
            for (at, r, block), fit in fits.items():
                train = (label[r] != block) & (label[r] >= 0)
                total[at, r, block] = total.get((at, r, block), 0) + fit.loo(m[train, :k], m[train, k], alphas)
        if total:
            ids = list(total)
            yield pa.RecordBatch.from_arrays([*[pa.array([i[j] for i in ids], pa.int32()) for j in range(3)], pa.array([total[i].tolist() for i in ids], pa.list_(pa.float64()))],
                                             names=["model", "repeat", "block", "e"])

    summed = rows.mapInArrow(errors, "model int, repeat int, block int, e array<double>").groupBy("model", "repeat", "block").agg(
        F.array(*[F.sum(F.get("e", F.lit(i))) for i in range(len(alphas))]).alias("e")).collect()
    chosen = {(r["model"], r["repeat"], r["block"]): float(alphas[int(np.argmin(np.round(np.array(r["e"]) / fits[r["model"], r["repeat"], r["block"]].n, 12)))]) for r in summed}

    def predicted(batches):
        for b in batches:
            m, keys = _matrix(b, cols), b["__key"]
            where = [dict(f) for f in b["__folds"].to_pylist()]
            label = {r: np.array([w.get(r, -1) for w in where]) for r in packed}
            for (at, r, block), alpha in chosen.items():
                test = np.flatnonzero(label[r] == block)
                if len(test):
                    n, fit = len(test), fits[at, r, block]
                    yield pa.RecordBatch.from_arrays([pa.array([models[at][0]] * n, pa.string()), pa.array([r] * n, pa.int32()), pa.array([block] * n, pa.int32()), keys.take(pa.array(test)),
                                                      pa.array(m[test, k] + shift[k]), pa.array(fit.predict(m[test, :k], alpha) + shift[k]), pa.array([alpha] * n)],
                                                     names=["dropped", "repeat", "fold", "key", "observed", "predicted", "alpha"])

    kind = T.StructType([T.StructField("dropped", T.StringType()), T.StructField("repeat", T.IntegerType()), T.StructField("fold", T.IntegerType()),
                         T.StructField("key", df.schema[key].dataType), *[T.StructField(n, T.DoubleType()) for n in ("observed", "predicted", "alpha")]])
    spark = df.sparkSession
    coefs = [(models[at][0], r, block, xs[j], float(c), chosen[at, r, block]) for (at, r, block) in chosen
             for j, c in zip(models[at][1], fits[at, r, block].coefficients(chosen[at, r, block]), strict=True)]
    table = spark.createDataFrame(coefs, "dropped string, repeat int, fold int, predictor string, coefficient double, alpha double")
    return RidgeStudy(rows.mapInArrow(predicted, kind).withColumnRenamed("key", key), table)


def ridge_cv(df: DataFrame, key: str, y: str, xs, folds: DataFrame, alphas=None) -> DataFrame:
    """repeat, fold, key, observed, predicted, alpha of `ridge_study` with all predictors."""
    return ridge_study(df, key, y, xs, folds, alphas).predictions.drop("dropped")


def ridge_importance(df: DataFrame, key: str, y: str, xs, folds: DataFrame, alphas=None) -> DataFrame:
    """Loss of cross-validated R2 when each predictor is left out, per repeat; all models come from the same passes."""
    from duskline.operators.regression import pred_metrics

    found = settled(ridge_study(df, key, y, xs, folds, alphas, drop=True).predictions)
    r2 = pred_metrics(found.withColumn("dropped", F.coalesce("dropped", F.lit(""))), "observed", "predicted", ["repeat", "dropped"]).select("repeat", "dropped", "r2")
    full = r2.where("dropped = ''").select("repeat", F.col("r2").alias("cv_r2"))
    return r2.where("dropped <> ''").withColumnRenamed("r2", "reduced_r2").join(full, "repeat").withColumn("delta_r2", F.col("cv_r2") - F.col("reduced_r2"))


def quantile_summary(df: DataFrame, value: str, by, ps=(0.05, 0.5, 0.95)) -> DataFrame:
    """Mean and quantiles of a value over folds and repeats; groups are bounded by their number."""
    return df.groupBy(*_list(by)).agg(F.avg(value).alias("mean"), *[F.percentile(value, F.lit(p)).alias(f"q{round(100 * p):02d}") for p in ps], F.count(value).alias("n"))
