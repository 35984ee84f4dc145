"""Composite analyses over the night table: one job per study, specifications as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.operators import association as at
from duskline.operators import regression as rg
from duskline.operators.joins import factor_levels, union_all

# The adjustment sets of the specification curve.
ADJUSTMENT_SETS = {
    "unadjusted": (),
    "clearness": ("clearness",),
    "day_radiation": ("day_rad",),
    "wind": ("wind",),
    "clearness+wind": ("clearness", "wind"),
    "dayrad+wind": ("day_rad", "wind"),
    "full(dayrad+clear+wind)": ("day_rad", "clearness", "wind"),
    "full+precip": ("day_rad", "clearness", "wind", "precip"),
}
COVARIATES = ("day_rad", "clearness", "wind", "precip")
CUTS = {"33/67": (1 / 3, 2 / 3), "25/75": (0.25, 0.75), "20/80": (0.20, 0.80)}
SPREADS = ("sd_tmin", "p90p10_tmin", "iqr_tmin")
SATURATION_METRICS = ("sd_tmin", "p90p10_tmin", "iqr_tmin", "sd_cool_rate", "p90p10_cool_rate", "sd_cool_total")


def _flags(sets: dict) -> dict:
    return {c: F.col("adjustment_set").isin([k for k, v in sets.items() if c in v]) for c in COVARIATES}


def simpson(nights: DataFrame, x: str, y: str, min_regime: int = 20) -> DataFrame:
    """Marginal, conditional and within-regime association with exact shift p, from one specification table."""
    specs = [{"estimand": "marginal", "conditioning": "none", "adjustment_set": "unadjusted"}]
    sets = {"unadjusted": (), "clearness": ("clearness",), "wind": ("wind",), "clearness+wind": ("clearness", "wind"),
            "clearness+wind+rh": ("clearness", "wind", "rh")}
    specs += [{"estimand": "conditional", "conditioning": k, "adjustment_set": k} for k in sets if k != "unadjusted"]
    specs += [{"estimand": "within_regime", "conditioning": r, "adjustment_set": "unadjusted", "where": F.col("regime") == r}
              for r in ("calm_clear", "mixed", "cloudy_windy")]
    rows = at.spec_rows(nights, specs)
    use = {c: F.col("adjustment_set").isin([k for k, v in sets.items() if c in v]) for c in ("clearness", "wind", "rh")}
    by = ["estimand", "conditioning"]
    res = at.rank_residuals(rows, x, y, ("clearness", "wind", "rh"), by, use, keep=("night_date", "year"))
    p = at.stratified_shift_p(res, "rx", "ry", "night_date", "year", by)
    r = at.pearson(res, "rx", "ry", by).drop("n")
    out = p.join(r, by)
    return out.where((F.col("estimand") != "within_regime") | (F.col("n") > min_regime))


def saturation(nights: DataFrame, x: str, metrics=SATURATION_METRICS, regime: str = "calm_clear", min_n: int = 20) -> DataFrame:
    """Within one regime, every dispersion metric against warmth, with exact shift p and adjusted p."""
    long = nights.where(F.col("regime") == regime).unpivot(["night_date", "year", x], list(metrics), "metric", "value")
    res = at.rank_residuals(long, x, "value", (), ["metric"], keep=("night_date", "year"))
    p = at.stratified_shift_p(res, "rx", "ry", "night_date", "year", ["metric"]).where(F.col("n") >= min_n)
    r = at.pearson(res, "rx", "ry", ["metric"]).select("metric", F.col("r").alias("rho"))
    return at.bh_adjust(p.join(r, "metric"), "p_shift")


def mechanism(nights: DataFrame, x: str, outcomes=("sd_cool_rate", "mean_cool_rate", "sd_tmin"), regime: str = "calm_clear",
              lags: int = 7) -> DataFrame:
    """HAC slopes of cooling outcomes on warmth within one regime."""
    long = nights.where(F.col("regime") == regime).unpivot(["night_date", x], list(outcomes), "outcome", "value")
    return rg.hac_slope(long, "value", x, "night_date", ["outcome"], lags)


def hypotheses(nights: DataFrame, x: str, regime_col: str, reference: dict[str, tuple[float, str]],
               covs=("day_rad", "clearness", "wind"), lags: int = 7) -> DataFrame:
    """Five directional hypotheses on a held-out sample, with adjusted p and verdicts.

    H1 and H3: rank association of dispersion with warmth in the calm-clear
    regime; H2: partial association over all nights; H4 and H5: HAC slopes.
    reference gives the development estimate and the predicted outcome per id.
    """
    cc = F.col(regime_col) == "calm_clear"
    rows = at.spec_rows(nights, [
        {"id": "H1", "y": F.col("sd_tmin"), "cond": False, "where": cc},
        {"id": "H2", "y": F.col("sd_tmin"), "cond": True},
        {"id": "H3", "y": F.col("sd_cool_total"), "cond": False, "where": cc},
    ])
    res = at.rank_residuals(rows, x, "y", covs, ["id"], {c: F.col("cond") for c in covs}, keep=("night_date", "year"))
    a = at.stratified_shift_p(res, "rx", "ry", "night_date", "year", ["id"]).join(
        at.pearson(res, "rx", "ry", ["id"]).drop("n"), "id").select(
        "id", F.col("r").alias("estimate"), F.col("p_shift").alias("p_raw"), "n")
    slopes = at.spec_rows(nights.where(cc), [
        {"id": "H4", "y": F.col("mean_cool_rate")}, {"id": "H5", "y": F.col("sd_cool_rate")}])
    b = rg.hac_slope(slopes, "y", x, "night_date", ["id"], lags).select(
        "id", F.col("beta").alias("estimate"), F.col("p").alias("p_raw"), "n")
    both = at.bh_adjust(union_all(a, b), "p_raw")
    ref = F.create_map(*[F.lit(v) for k, (e, _) in reference.items() for v in (k, float(e))])
    exp = F.create_map(*[F.lit(v) for k, (_, w) in reference.items() for v in (k, w)])
    both = both.withColumns({"dev_estimate": ref[F.col("id")], "predicted": exp[F.col("id")]})
    return both.withColumn("verdict", at.verdict("estimate", "dev_estimate", "p_bh", "predicted"))


def spec_samples(layers: DataFrame, dev_years, holdout_years, cuts=CUTS, by=("win",), digits: int = 9) -> DataFrame:
    """Layer rows by year set and by sample: all nights once, and the calm-clear nights of every cut.

    Cut points are learnt on the development years of each layer.
    """
    by = list(by)
    ps = F.array(*[F.lit(float(hi)) for _, hi in cuts.values()])
    th = layers.where(F.col("year").isin(list(dev_years))).groupBy(*by).agg(
        F.percentile("calm_clear_index", ps).alias("__hi"))
    rows = layers.join(th, by)
    hit = lambda i: F.col("calm_clear_index") >= F.round(F.get("__hi", F.lit(i)), digits)
    rows = at.spec_rows(rows, [{"sample": "all_nights", "cut": "any"}] + [
        {"sample": "calm_clear_only", "cut": c, "where": hit(i)} for i, c in enumerate(cuts)]).drop("__hi")
    return at.spec_rows(rows, [
        {"years": "all"}, {"years": "dev", "where": F.col("year").isin(list(dev_years))},
        {"years": "holdout", "where": F.col("year").isin(list(holdout_years))}])


def distinct_spec_curve(layers: DataFrame, dev_years, holdout_years, outcomes, by=("win",), x: str = "warmth", min_n: int = 30,
                        sets=None) -> DataFrame:
    """Every distinct specification, estimated in one grouped job."""
    sets = sets or ADJUSTMENT_SETS
    by = list(by)
    rows = spec_samples(layers, dev_years, holdout_years, by=by)
    rows = at.spec_rows(rows, [{"outcome": o, "y": F.col(o)} for o in outcomes])
    rows = factor_levels(rows.select(*by, "years", "sample", "cut", "outcome", x, "y", *COVARIATES), adjustment_set=list(sets))
    keys = [*by, "cut", "outcome", "adjustment_set", "years", "sample"]
    return at.partial_spearman(rows, x, "y", COVARIATES, keys, min_n, _flags(sets))


def spec_curve(distinct: DataFrame, cuts=CUTS) -> DataFrame:
    """All crossed specifications: the all-nights ones do not depend on the cut and repeat for each."""
    same = F.array(*[F.lit(c) for c in cuts])
    return distinct.withColumn("cut", F.explode(F.when(F.col("cut") == "any", same).otherwise(F.array("cut")))).where(
        F.col("rho").isNotNull())


def retention(profiles: DataFrame, drivers, complete: str = "complete", slope: str = "tail_slope") -> DataFrame:
    """Why nights drop out of the slope analysis: incomplete window, late peak, missing driver, kept."""
    missing = F.lit(False)
    for d in drivers:
        missing = missing | F.col(d).isNull()
    reason = (F.when(~F.col(complete), "incomplete_window").when(F.col(slope).isNull(), "late_peak")
              .when(missing, "missing_driver").otherwise("kept"))
    return profiles.withColumn("reason", reason)
