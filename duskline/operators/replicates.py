"""Bootstraps on a replicate axis.

A scope's nights (a calendar's worth, folded before) meet the draws of a chunk of
replicates in one task. There every night is a vector of multiplicities, one entry
per replicate; values are sorted once, weighted ranks of all replicates are
prefix sums of those vectors, and statistics are matrix products. Rows are
never copied per replicate, and what crosses to a task are nights and block
starts. Chunks of replicates are independent, so tasks grow with scopes x chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Replicates of one task.
CHUNK = 250
#: Days that a season may have on the stacked calendar of a task.
STRIDE = 400


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# --- weights ------------------------------------------------------------------


def block_weights(starts: pd.DataFrame, rows: pd.DataFrame, reps: np.ndarray, year: str = "year") -> np.ndarray:
    """Rows x replicates: how often each row's day lies in a drawn block. starts: replicate, year, start, take."""
    years = {y: i for i, y in enumerate(sorted(set(starts[year])))}
    at = starts[year].map(years).to_numpy() * STRIDE + starts["start"].to_numpy()
    rep = starts["replicate"].to_numpy() - reps[0]
    steps = np.zeros((len(years) * STRIDE + 1, len(reps)))
    np.add.at(steps, (at, rep), 1)
    np.add.at(steps, (at + starts["take"].to_numpy(), rep), -1)
    day = rows[year].map(years).to_numpy() * STRIDE + rows["day_index"].to_numpy(int)
    return np.cumsum(steps, axis=0)[day]


def key_weights(draws: pd.DataFrame, rows: pd.DataFrame, reps: np.ndarray, key: list[str]) -> np.ndarray:
    """Rows x replicates from (replicate, key, times) draws."""
    keys = {k: i for i, k in enumerate(dict.fromkeys(map(tuple, rows[key].to_numpy().tolist())))}
    found = [keys.get(k, -1) for k in map(tuple, draws[key].to_numpy().tolist())]
    w = np.zeros((len(keys) + 1, len(reps)))
    np.add.at(w, (np.array(found, int), draws["replicate"].to_numpy() - reps[0]), draws["times"].to_numpy())
    return w[[keys[k] for k in map(tuple, rows[key].to_numpy().tolist())]]


# --- statistics ---------------------------------------------------------------


def weighted_ranks(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Average ranks of v in every replicate (rows x replicates); a row counts as often as its weight says."""
    order = np.argsort(v, kind="stable")
    ordered = v[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    tied = np.add.reduceat(w[order], np.flatnonzero(new), axis=0)
    rank = np.cumsum(tied, axis=0) - tied + (tied + 1) / 2
    out = np.empty_like(w)
    out[order] = rank[np.cumsum(new) - 1]
    return out


def weighted_covariances(w: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Replicates x k x k matrices n * sum(ab) - sum(a) sum(b); values are rows x replicates, or rows x 1 if they are the same in all."""
    n = w.sum(0)
    sums = [(w * v).sum(0) for v in values]
    k = len(values)
    out = np.empty((w.shape[1], k, k))
    for i in range(k):
        for j in range(i, k):
            out[:, i, j] = out[:, j, i] = n * (w * values[i] * values[j]).sum(0) - sums[i] * sums[j]
    return out


def swept_correlation(cov: np.ndarray, min_n: int, n: np.ndarray) -> np.ndarray:
    """Partial correlation of the first two variables given the others, for each matrix; NaN where undefined."""
    whole, m = cov, cov.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for z in range(2, cov.shape[1]):
            usable = m[:, z, z] > 1e-10 * whole[:, z, z]
            step = m[:, :, z, None] * m[:, None, z, :] / np.where(usable, m[:, z, z], 1.0)[:, None, None]
            m = np.where(usable[:, None, None], m - step, m)
        ok = (n >= min_n) & (m[:, 0, 0] > 1e-10 * whole[:, 0, 0]) & (m[:, 1, 1] > 1e-10 * whole[:, 1, 1])
        return np.where(ok, m[:, 0, 1] / np.sqrt(m[:, 0, 0] * m[:, 1, 1]), np.nan)


def distinct_drawn(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Different values among the drawn rows of each replicate."""
    order = np.argsort(v, kind="stable")
    first = np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1]])
    return (np.add.reduceat(w[order], first, axis=0) > 0).sum(0)


def rank_correlation(x: str, y: str, covs=(), raw=(), min_n: int = 3, least_x: int = 0) -> Callable:
    """Statistic for `apply`: (partial) rank correlation; NaN where fewer than `min_n` rows or not more than `least_x` different x are drawn."""
    names = [x, y, *covs]

    def stat(rows: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        v = [rows[c].to_numpy(float) for c in names]
        values = [a[:, None] - a.mean() if c in raw else weighted_ranks(a, w) for c, a in zip(names, v, strict=True)]
        out = swept_correlation(weighted_covariances(w, values), min_n, w.sum(0))
        return np.where(distinct_drawn(v[0], w) > least_x, out, np.nan) if least_x else out

    return stat


def slope(x: str, y: str, least_x: int = 0) -> Callable:
    """Statistic for `apply`: least-squares slope."""

    def stat(rows: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        a, b = (rows[c].to_numpy(float) for c in (x, y))
        m = weighted_covariances(w, [(a - a.mean())[:, None], (b - b.mean())[:, None]])
        many = distinct_drawn(a, w)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((many > max(1, least_x)), m[:, 0, 1] / m[:, 0, 0], np.nan)

    return stat


def mean_columns(columns: list[str]) -> Callable:
    """Statistic for `apply_many`: weighted means of several columns, each over its rows that are not null."""

    def stat(rows: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        v = rows[columns].to_numpy(float)
        there = ~np.isnan(v)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.where(there, v, 0).T @ w) / (there.T.astype(float) @ w)

    return stat


def least_squares(sums: np.ndarray) -> np.ndarray:
    """Coefficients of every column of packed upper triangles of cross products of [1, x..., y] (triangle x replicates -> coefficients x replicates)."""
    k = int((np.sqrt(8 * sums.shape[0] + 1) - 1) / 2)
    m = np.zeros((sums.shape[1], k, k))
    i, j = np.triu_indices(k)
    m[:, i, j] = m[:, j, i] = sums.T
    a, b = m[:, :-1, :-1], m[:, :-1, -1]
    d = 1 / np.sqrt(np.maximum(np.einsum("bii->bi", a), 1e-300))
    inv = np.linalg.pinv(a * d[:, :, None] * d[:, None, :], rcond=1e-12, hermitian=True)
    return (d * np.einsum("bij,bj->bi", inv, d * b)).T


# --- the job ------------------------------------------------------------------


def apply(rows: DataFrame, draws: DataFrame, reps: int, stat: Callable, by=(), weights: Callable = block_weights, many: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """by, replicate and `est` (or `name`, `est` for each of `many`): the statistic of every replicate.

    rows: a scope's folded nights or clusters. draws: by, replicate and what
    `weights` needs. stat(rows, weights) gives one number per replicate, or with `many`
    a line of numbers per name. NaN becomes NULL. Every scope of rows gets all replicates.
    """
    by = _list(by)
    chunks = -(-reps // chunk)
    left = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # aliases give the draws columns of their own where both sides come from one table
    right = draws.select(*[F.col(c).alias(f"__by_{c}" if c in by else c) for c in draws.columns]).withColumn("__chunk", F.floor(F.col("replicate") / chunk).cast("int"))
    keys = [f"__by_{b}" for b in by]
    fields = [rows.schema[b] for b in by] + [T.StructField("replicate", T.IntegerType())]
    fields += [T.StructField("name", T.StringType())] if many is not None else []
    out = T.StructType([*fields, T.StructField("est", T.DoubleType())])

    def run(key: tuple, r: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(d):
            return pd.DataFrame(columns=out.names)
        first = key[-1] * chunk
        at = np.arange(first, min(first + chunk, reps))
        est = stat(r, weights(d.rename(columns=dict(zip(keys, by, strict=True))), r, at))
        head = dict(zip(by, key[:-1], strict=True))
        if many is None:
            return pd.DataFrame({**head, "replicate": at.astype(np.int32), "est": pd.array(est, "Float64").to_numpy(object, na_value=None)})[out.names]
        est = np.asarray(est)
        return pd.DataFrame({**head, "replicate": np.tile(at, len(many)).astype(np.int32), "name": np.repeat(many, len(at)), "est": est.ravel()})[out.names]

    found = left.groupBy(*by, "__chunk").cogroup(right.groupBy(*keys, "__chunk")).applyInPandas(run, out)
    return found.withColumn("est", F.when(~F.isnan("est"), F.col("est")))


def apply_sums(sums: DataFrame, names: list[str], draws: DataFrame, reps: int, stat: Callable, many: list[str], by=(), weights: Callable = block_weights) -> DataFrame:
    """As `apply` with `many`, from per-night sums: stat gets the weighted totals (names x replicates)."""

    def total(rows: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        return stat(rows[names].to_numpy(float).T @ w)

    return apply(sums, draws, reps, total, by, weights, many)
