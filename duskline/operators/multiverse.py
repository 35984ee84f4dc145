"""Selections of many decisions over many cells: decisions are an axis, not rows.

A cell is one row with its scores under every decision. The cut of every decision
and share comes from two passes over the cells, which are never shuffled:

1. histograms of the scores in each task, added up by decision: in which bin the
   last place of each share lies, and how many cells stand above that bin;
2. only the cells of these bins, some ten-thousandths of all scores, are ranked exactly, ties
   by key, by `ranks.cumulative_counts`, so a value that all cells share is one row.

Cut scores and the last key of a tie are a table of decisions by shares, a size set
by parameters. With them a cell decides alone whether it is selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.operators.ranks import cumulative_counts
from duskline.operators.selection import DECISION, TOP_SHARES, score, signature_digits, weight_scenarios, with_duplicates
from duskline.session import settled

#: Bins of a score between 0 and 100.
BINS = 1 << 14
BASELINE = ("gp", "baseline", "qmargin")


@dataclass(frozen=True)
class Cuts:
    """Cut score and last key of its tie, decisions x shares: all that a task needs to select."""

    key: str
    score: np.ndarray
    last: np.ndarray

    def selected(self, batch: pa.RecordBatch) -> np.ndarray:
        """cells x decisions x shares."""
        s, key = _scores(batch, len(self.score))[:, :, None], np.asarray(batch[self.key])[:, None, None]
        with np.errstate(invalid="ignore"):
            return (s > self.score) | ((s == self.score) & (key <= self.last))


@dataclass(frozen=True)
class Multiverse:
    """cells: key, `scores` by decision and what else was kept, settled."""

    cells: DataFrame
    key: str
    names: list[tuple[str, str, str]]
    shares: tuple
    cuts: Cuts

    def axis(self, test) -> np.ndarray:
        """Numbers of the decisions that pass test(heat field, weight scenario, lens)."""
        return np.array([i for i, n in enumerate(self.names) if test(*n)])


def decision_scores(ranked: DataFrame, key: str, fields: dict[str, str], lenses: dict[str, str], keep=(), scenarios=None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """One row per cell: key, `keep`, and `scores` under every (heat field, weight scenario, population lens), in the order of the names."""
    scenarios = scenarios or weight_scenarios()
    names = [(f, w, l) for f in fields for w in scenarios for l in lenses]
    each = [score(fields[f], lenses[l], "cooling", "intensity", scenarios[w]) for f, w, l in names]
    return ranked.select(key, *keep, F.array(*each).alias("scores")), names


def _scores(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """cells x decisions; a missing score is NaN."""
    return pc.fill_null(batch["scores"].flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, n)


def _bins(scores: np.ndarray) -> np.ndarray:
    """Bin of every score; a greater score has no lower bin, missing scores have none."""
    with np.errstate(invalid="ignore"):
        at = np.clip(scores * (BINS / 100.0), 0, BINS - 1)
    return np.where(np.isnan(at), -1, at).astype(np.int32)


def _histograms(n: int):
    def run(batches):
        total = np.zeros(n * BINS, np.int64)
        for b in batches:
            at = _bins(_scores(b, n))
            total += np.bincount((at + np.arange(n, dtype=np.int32) * BINS)[at >= 0], minlength=n * BINS)
        for d, line in enumerate(total.reshape(n, BINS)):
            used = np.flatnonzero(line)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), d, np.int32)), pa.array(used.astype(np.int32)), pa.array(line[used])], names=["d", "bin", "n"])

    return run


def _in_bins(key: str, n: int, marks: np.ndarray):
    """Scores in the marked bins (decision x share): (at, key, neg), at numbers decision and bin, neg is the score with its sign turned."""
    wanted = np.zeros((n, BINS), bool)
    np.put_along_axis(wanted, np.maximum(marks, 0), marks >= 0, 1)

    def run(batches):
        for b in batches:
            s = _scores(b, n)
            at = _bins(s)
            c, d = np.nonzero(wanted[np.arange(n), at] & (at >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64) * BINS + at[c, d]), b[key].take(pa.array(c)), pa.array(-s[c, d])], names=["at", key, "neg"])

    return run


def multiverse(scored: DataFrame, key: str, names, shares=TOP_SHARES) -> Multiverse:
    """Exactly the ceil(share * n) best cells of every decision and share, ties to the lower key. scored: of `decision_scores`, with an integer key."""
    cells, n, shares = settled(scored), len(names), tuple(float(s) for s in shares)
    counts = cells.select("scores").mapInArrow(_histograms(n), "d int, bin int, n long").groupBy("d", "bin").agg(F.sum("n").alias("n"))
    found = np.zeros((n, BINS), np.int64)
    table = counts.toArrow()  # a size set by parameters
    found[table["d"].to_numpy(), table["bin"].to_numpy()] = table["n"].to_numpy()
    total = found.sum(1)
    places = np.stack([np.ceil(np.round(s * total, 9)) for s in shares], axis=1).astype(np.int64)  # decisions x shares
    above = found[:, ::-1].cumsum(1)[:, ::-1]  # cells in the bin or a higher one
    marks = np.stack([(above >= places[:, [i]]).sum(1) - 1 for i in range(len(shares))], axis=1)
    marks = np.where(total[:, None] > 0, marks, -1)
    better = np.take_along_axis(np.c_[above, np.zeros(n, np.int64)], marks + 1, 1)

    wanted = settled(cells.select(key, "scores").mapInArrow(_in_bins(key, n, marks), T.StructType([T.StructField("at", T.LongType()), cells.schema[key], T.StructField("neg", T.DoubleType())])))
    need = [(int(d) * BINS + int(marks[d, i]), int(d), int(i), int(places[d, i] - better[d, i])) for d in range(n) for i in range(len(shares)) if marks[d, i] >= 0]
    needs = cells.sparkSession.createDataFrame(need, "at long, d int, i int, need long")  # a row per decision and share
    ranked = cumulative_counts(wanted, ["at"], "neg").join(F.broadcast(needs), "at")
    cut = settled(ranked.where((F.col("below") < F.col("need")) & (F.col("need") <= F.col("below") + F.col("n"))).select(
        "at", "d", "i", F.col("value").alias("neg"), (F.col("need") - F.col("below")).alias("need"), "n"))
    cuts, last = np.full((n, len(shares)), np.inf), np.full((n, len(shares)), np.iinfo(np.int64).max)
    rows = cut.collect()
    for r in rows:
        cuts[r["d"], r["i"]] = -r["neg"]
    if any(r["need"] < r["n"] for r in rows):
        small = F.broadcast(cut.where("need < n").select("at", "neg", "d", "i", "need"))
        tied = settled(wanted.join(small, ["at", "neg"]).select("d", "i", "need", key))
        for r in cumulative_counts(tied, ["d", "i", "need"], key).where(F.col("below") + 1 == F.col("need")).select("d", "i", F.col("value").alias("last")).collect():
            last[r["d"], r["i"]] = r["last"]
    return Multiverse(cells, key, list(names), shares, Cuts(key, cuts, last))


def _baseline(m: Multiverse, baseline) -> int:
    return m.names.index(tuple(baseline))


def decision_table(m: Multiverse, population: str, baseline=BASELINE) -> DataFrame:
    """Per decision and share: size, overlap and Jaccard with the baseline, selected population, which `cells` have kept."""
    base, n, shares, cuts = _baseline(m, baseline), len(m.names), m.shares, m.cuts

    def run(batches):
        counts, sums = np.zeros((3, n, len(shares)), np.int64), np.zeros((n, len(shares)))
        for b in batches:
            s = cuts.selected(b)
            own = s[:, [base], :]
            people = np.nan_to_num(np.asarray(b[population].to_numpy(zero_copy_only=False), float))
            counts += np.stack([s.sum(0), (s & own).sum(0), (s | own).sum(0)])
            sums += np.tensordot(people, s, 1)
        d, i = (x.ravel() for x in np.indices((n, len(shares))))
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(i), *[pa.array(c.ravel()) for c in counts], pa.array(sums.ravel())], names=["d", "i", "a", "b", "u", "p"])

    parts = m.cells.select(m.key, "scores", population).mapInArrow(run, "d long, i long, a long, b long, u long, p double")
    g = parts.groupBy("d", "i").agg(F.sum("a").alias("n_selected"), F.sum("b").alias("overlap"), F.sum("u").alias("__u"), F.sum("p").alias("selected_population"))
    name = F.get(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(DECISION, x)]) for x in m.names]), F.col("d").cast("int"))
    share = F.get(F.array(*[F.lit(s) for s in shares]), F.col("i").cast("int"))
    g = g.select(name.alias("__d"), share.alias("share"), "n_selected", "overlap", "__u", "selected_population")
    return g.select("__d.*", "share", "n_selected", "overlap", (F.col("overlap") / F.when(F.col("__u") > 0, F.col("__u"))).alias("jaccard"), "selected_population")


def frequencies(m: Multiverse, scopes: dict[str, np.ndarray], baseline=BASELINE) -> DataFrame:
    """key, share, baseline, and for every scope how often the cell is selected under its decisions."""
    base, shares, cuts = _baseline(m, baseline), m.shares, m.cuts
    schema = T.StructType([m.cells.schema[m.key], T.StructField("share", T.DoubleType()), T.StructField("baseline", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in scopes]])

    def run(batches):
        for b in batches:
            s = cuts.selected(b)
            some = [s[:, at, :].sum(1) / float(len(at)) for at in scopes.values()]
            key = b[cuts.key].take(pa.array(np.repeat(np.arange(len(s)), len(shares))))
            yield pa.RecordBatch.from_arrays([key, pa.array(np.tile(shares, len(s))), pa.array(s[:, base, :].ravel()), *[pa.array(f.ravel()) for f in some]], names=schema.names)

    return m.cells.select(m.key, "scores").mapInArrow(run, schema)


def selection_frequency(m: Multiverse, baseline=BASELINE) -> DataFrame:
    """Per cell and share: selection frequency over all decisions and along each dimension."""
    bf, bw, bl = baseline
    return frequencies(m, {
        "freq_all": m.axis(lambda f, w, l: True), "freq_weights": m.axis(lambda f, w, l: f == bf and l == bl), "freq_lenses": m.axis(lambda f, w, l: f == bf and w == bw),
        "freq_fields": m.axis(lambda f, w, l: w == bw and l == bl), "freq_leave_one_out": m.axis(lambda f, w, l: f == bf and l == bl and w.startswith("leave_out_"))}, baseline)


def signatures(m: Multiverse) -> DataFrame:
    """As `selection.decision_signatures`, from the cells' arrays of scores."""
    rows = m.cells.select(m.key, F.posexplode("scores").alias("d", "score"))
    sig = rows.groupBy("d").agg(F.sum(signature_digits(m.key, F.col("score"))).cast("string").alias("signature"), F.count("*").alias("n"))
    name = F.get(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(DECISION, x)]) for x in m.names]), F.col("d"))
    return with_duplicates(sig.select(name.alias("__d"), "signature", "n").select("__d.*", "signature", "n"))
