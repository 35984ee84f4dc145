"""Rank association, regression and specification studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.functions import timeparts as tp
from duskline.operators import aggregates as ag
from duskline.operators import association as at
from duskline.operators import panel, ranks, scalars, series, studies
from duskline.operators import regression as rg
from duskline.plans import ctes as c
from duskline.plans.basics import PROFILE, sunset_profile
from duskline.plans.registry import query
from duskline.session import settled
from duskline.sources import mapping as m
from duskline.sources.tables import Tables


def in_dev():
    return F.col("year").isin(list(m.DEV_YEARS))


def fixed_nights(t: Tables) -> DataFrame:
    """The night table, folded once from the raw tables and checkpointed."""
    return settled(m.nights(t))


@query("pearson_by_regime", "T1", "regime:s r n:i", c.with_(c.NIGHTS) + """
    SELECT regime, corr(warmth, sd_tmin) AS r, count(*) AS n FROM nights WHERE warmth IS NOT NULL AND sd_tmin IS NOT NULL GROUP BY regime""")
def pearson_by_regime(t: Tables) -> DataFrame:
    return at.pearson(m.nights(t), "warmth", "sd_tmin", ["regime"])


@query("pearson_without_variance", "T1", "year:i r n:i", c.with_(c.NIGHTS) + """
    SELECT year, NULL AS r, count(*) AS n FROM nights GROUP BY year""")
def pearson_without_variance(t: Tables) -> DataFrame:
    return at.pearson(m.nights(t).withColumn("flat", F.lit(1.0)), "warmth", "flat", ["year"])


@query("spearman_by_regime", "T2 W4", "regime:s rho n:i", c.with_(c.NIGHTS) + f""",
    b AS (SELECT * FROM nights WHERE sd_cool_total IS NOT NULL),
    r AS (SELECT regime, {c.rank_avg('warmth', 'regime')} a, {c.rank_avg('sd_cool_total', 'regime')} b FROM b)
    SELECT regime, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY regime""")
def spearman_by_regime(t: Tables) -> DataFrame:
    return at.spearman(m.nights(t), "warmth", "sd_cool_total", ["regime"])


@query("partial_spearman_by_regime", "T3", "regime:s rho n:i", c.with_(c.NIGHTS,
       "b AS (SELECT * FROM nights WHERE clearness IS NOT NULL AND sd_tmin IS NOT NULL)",
       c.partial_sql("p", "b", "regime", "warmth", "sd_tmin", ("day_rad", "clearness", "rh"))) + "SELECT * FROM p")
def partial_spearman_by_regime(t: Tables) -> DataFrame:
    return at.partial_spearman(m.nights(t), "warmth", "sd_tmin", ("day_rad", "clearness", "rh"), ["regime"])


_SEASON = ("season", "season_sq", "year_1996", "year_1997", "year_1998", "year_1999", "year_2000", "year_2001")


@query("partial_spearman_season_year", "T3 P19 P20", "sample:s rho n:i", c.with_(c.NIGHTS, """
    b AS (SELECT 'all' AS sample, warmth, sd_tmin, (doy - 196.5) / 30.0 AS season, ((doy - 196.5) / 30.0) ** 2 AS season_sq,
          (year = 1996)::INT AS year_1996, (year = 1997)::INT AS year_1997, (year = 1998)::INT AS year_1998,
          (year = 1999)::INT AS year_1999, (year = 2000)::INT AS year_2000, (year = 2001)::INT AS year_2001
          FROM (SELECT *, dayofyear(night_date)::DOUBLE AS doy FROM nights) WHERE sd_tmin IS NOT NULL)""",
       c.partial_sql("p", "b", "sample", "warmth", "sd_tmin", _SEASON, raw=_SEASON)) + "SELECT * FROM p")
def partial_spearman_season_year(t: Tables) -> DataFrame:
    s, s2 = tp.season_terms(F.dayofyear("night_date"))
    n = scalars.one_hot(m.nights(t).withColumns({"season": s, "season_sq": s2, "sample": F.lit("all")}), "year", m.YEARS)
    return at.partial_spearman(n, "warmth", "sd_tmin", _SEASON, ["sample"], raw=_SEASON)


@query("shift_test_by_year", "T4", "year:i p_shift n_rotations:i", c.with_(c.NIGHTS) + f""",
    r AS (SELECT year, {c.rank_avg('warmth', 'year')} rx, {c.rank_avg('sd_tmin', 'year')} ry, night_date FROM nights WHERE sd_tmin IS NOT NULL),
    z AS (SELECT year, rx - avg(rx) OVER (PARTITION BY year) x, ry - avg(ry) OVER (PARTITION BY year) y,
                 row_number() OVER (PARTITION BY year ORDER BY night_date) - 1 i, count(*) OVER (PARTITION BY year) n FROM r),
    s AS (SELECT a.year, a.n, (b.i - a.i + a.n) % a.n AS sh, sum(a.x * b.y) / sqrt(sum(a.x * a.x) * sum(b.y * b.y)) v FROM z a JOIN z b USING (year) GROUP BY ALL)
    SELECT s.year, count(*) FILTER (abs(s.v) >= abs(o.v) - 1e-9)::DOUBLE / count(*) AS p_shift, count(*) AS n_rotations
    FROM s JOIN s o ON o.year = s.year AND o.sh = 0 GROUP BY s.year""")
def shift_test_by_year(t: Tables) -> DataFrame:
    r = at.rank_residuals(m.nights(t), "warmth", "sd_tmin", (), ["year"], keep=("night_date",))
    return at.shift_p(r, "rx", "ry", "night_date", ["year"])


@query("stratified_shift_test", "T5", "regime:s p_shift n:i n_randomizations:f0", c.with_(c.NIGHTS, """
    b AS (SELECT regime, night_date, year, warmth AS x, sd_tmin AS y FROM nights WHERE sd_tmin IS NOT NULL AND year <= 1998)""",
       c.resid_sql("r", "b", "regime", (), "night_date, year"), c.shift_sql("p", "r", "regime", 4)) + "SELECT * FROM p")
def stratified_shift_test(t: Tables) -> DataFrame:
    n = fixed_nights(t).where(in_dev())
    r = at.rank_residuals(n, "warmth", "sd_tmin", (), ["regime"], keep=("night_date", "year"))
    return at.stratified_shift_p(r, "rx", "ry", "night_date", "year", ["regime"])


@query("adjusted_p_values", "T6", "year:i p_shift p_bh", c.with_(c.NIGHTS) + f""",
    r AS (SELECT year, {c.rank_avg('wind', 'year')} rx, {c.rank_avg('sd_tmin', 'year')} ry FROM nights WHERE sd_tmin IS NOT NULL),
    q AS (SELECT year, n, r, {c.normal_p('r * sqrt(n - 1)')} AS p_shift FROM (SELECT year, count(*) n, corr(rx, ry) r FROM r GROUP BY year)),
    """ + c.bh_sql("b", "q", "p_shift") + " SELECT year, p_shift, p_bh FROM b")
def adjusted_p_values(t: Tables) -> DataFrame:
    from duskline.functions.numeric import normal_two_sided_p

    s = at.spearman(m.nights(t), "wind", "sd_tmin", ["year"])
    p = s.withColumn("p_shift", normal_two_sided_p(F.col("rho") * F.sqrt(F.col("n") - 1)))
    return at.bh_adjust(p, "p_shift")


@query("clearness_model", "T7 Q2", "term:s estimate se r2 resid_sd n:i p", None)
def clearness_model(t: Tables) -> DataFrame:
    return rg.ols(m.daily_weather(t), "day_rad", ["wind", "rh"], fit_where=F.year("night_date").isin(list(m.DEV_YEARS)))


@query("clearness_residuals", "T7 Q2", "night_date:d fitted resid", c.with_(c.DAILY_WEATHER) + """,
    v AS (SELECT avg(wind) m1, avg(rh) m2, avg(day_rad) my, var_pop(wind) s11, var_pop(rh) s22, covar_pop(wind, rh) s12,
                 covar_pop(wind, day_rad) s1y, covar_pop(rh, day_rad) s2y FROM daily_weather WHERE year(night_date) <= 1998),
    k AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) b2 FROM v)
    SELECT night_date, my + b1 * (wind - m1) + b2 * (rh - m2) AS fitted, day_rad - (my + b1 * (wind - m1) + b2 * (rh - m2)) AS resid
    FROM daily_weather, k""")
def clearness_residuals(t: Tables) -> DataFrame:
    return rg.predict(m.daily_weather(t), "day_rad", ["wind", "rh"], fit_where=F.year("night_date").isin(list(m.DEV_YEARS)))


@query("ols_coefficients_by_year", "T7", "year:i term:s estimate se r2 n:i", c.with_(c.NIGHTS) + """,
    v AS (SELECT year, count(*) n, avg(warmth) m1, avg(rh) m2, avg(sd_tmin) my, var_pop(warmth) s11, var_pop(rh) s22, covar_pop(warmth, rh) s12,
                 covar_pop(warmth, sd_tmin) s1y, covar_pop(rh, sd_tmin) s2y, var_pop(sd_tmin) syy FROM nights GROUP BY year),
    k AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) b2, s11 * s22 - s12 * s12 d FROM v),
    e AS (SELECT *, (syy - b1 * s1y - b2 * s2y) * n / (n - 3) AS s2 FROM k)
    SELECT year, 'intercept' AS term, my - b1 * m1 - b2 * m2 AS estimate,
           sqrt(s2 / n * (1 + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / d)) AS se, (b1 * s1y + b2 * s2y) / syy AS r2, n FROM e
    UNION ALL SELECT year, 'warmth', b1, sqrt(s2 / n * s22 / d), (b1 * s1y + b2 * s2y) / syy, n FROM e
    UNION ALL SELECT year, 'rh', b2, sqrt(s2 / n * s11 / d), (b1 * s1y + b2 * s2y) / syy, n FROM e""")
def ols_coefficients_by_year(t: Tables) -> DataFrame:
    return rg.ols(m.nights(t), "sd_tmin", ["warmth", "rh"], by=["year"])


@query("hac_slope_by_regime", "T8 J15 Q3", "regime:s beta se p r2 n:i", c.with_(c.NIGHTS,
       "b AS (SELECT * FROM nights WHERE sd_tmin IS NOT NULL)", c.hac_sql("h", "b", "regime", "sd_tmin", "warmth", 7)) + "SELECT * FROM h")
def hac_slope_by_regime(t: Tables) -> DataFrame:
    return rg.hac_slope(m.nights(t), "sd_tmin", "warmth", "night_date", ["regime"], 7)


@query("hac_model_drivers", "T8 Q9 Q16", "term:s beta se p r2 n:i")
def hac_model_drivers(t: Tables) -> DataFrame:
    z = scalars.zscore(fixed_nights(t), ["warmth", "day_rad", "clearness", "wind", "rh"])
    return rg.hac_ols(z, "sd_tmin", [f"z_{v}" for v in ("warmth", "day_rad", "clearness", "wind", "rh")], "night_date", lags=7)


_RANKED = ", ".join(f"{c.rank_avg(v, 'regime')} AS {v}" for v in ("sd_tmin", "warmth", "day_rad", "wind"))
_STANDARD = ", ".join(f"({v} - avg({v}) OVER w) / stddev_pop({v}) OVER w AS {v}" for v in ("sd_tmin", "warmth", "day_rad", "wind"))


@query("rank_hac_model", "T9 Q16", "regime:s term:s beta se p n:i", c.with_(c.NIGHTS, f"""
    rk AS (SELECT regime, night_date, {_RANKED} FROM nights WHERE sd_tmin IS NOT NULL AND warmth IS NOT NULL AND day_rad IS NOT NULL AND wind IS NOT NULL),
    rz AS MATERIALIZED (SELECT regime, night_date, {_STANDARD} FROM rk WINDOW w AS (PARTITION BY regime))""",
       c.hac_terms_sql("h", "rz", "regime", "sd_tmin", ["warmth", "day_rad", "wind"], 14)) + "SELECT * FROM h")
def rank_hac_model(t: Tables) -> DataFrame:
    return rg.hac_ols(m.nights(t), "sd_tmin", ["warmth", "day_rad", "wind"], "night_date", ["regime"], 14, rank=True)


@query("hac_multi_check", "T8", "year:i beta se p", c.with_(c.NIGHTS, c.hac_sql("h", "nights", "year", "iqr_tmin", "warmth", 7)) + "SELECT year, beta, se, p FROM h")
def hac_multi_check(t: Tables) -> DataFrame:
    return rg.hac_ols(m.nights(t), "iqr_tmin", ["warmth"], "night_date", ["year"], 7).where("term = 'warmth'")


@query("mann_whitney_regimes", "T10 Q6", "year:i u:f2 z p", c.with_(c.NIGHTS) + f""",
    b AS (SELECT year, regime, day_rad FROM nights WHERE regime IN ('calm_clear', 'cloudy_windy')),
    r AS (SELECT *, {c.rank_avg('day_rad', 'year')} rk, count(*) OVER (PARTITION BY year, day_rad) tt FROM b),
    s AS (SELECT year, count(*) FILTER (regime = 'calm_clear')::DOUBLE n1, count(*) FILTER (regime = 'cloudy_windy')::DOUBLE n2,
                 sum(rk) FILTER (regime = 'calm_clear') r1, sum(tt * tt - 1)::DOUBLE tie FROM r GROUP BY year),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1)))) sd FROM s)
    SELECT year, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS z,
           least(1.0, {c.normal_p('(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd')}) AS p FROM u""")
def mann_whitney_regimes(t: Tables) -> DataFrame:
    return at.mann_whitney(m.nights(t), "day_rad", "regime", "calm_clear", "cloudy_windy", ["year"])


_SIMPSON_USE = {"clearness": "conditioning IN ('clearness', 'clearness+wind', 'clearness+wind+rh')",
                "wind": "conditioning IN ('wind', 'clearness+wind', 'clearness+wind+rh')", "rh": "conditioning = 'clearness+wind+rh'"}


@query("simpson_decomposition", "T11 Q3", "estimand:s conditioning:s r p_shift n:i", c.with_(c.NIGHTS, """
    sp AS (SELECT * FROM (VALUES ('marginal', 'none'), ('conditional', 'clearness'), ('conditional', 'wind'), ('conditional', 'clearness+wind'),
           ('conditional', 'clearness+wind+rh'), ('within_regime', 'calm_clear'), ('within_regime', 'mixed'), ('within_regime', 'cloudy_windy')) v(estimand, conditioning)),
    b AS (SELECT estimand, conditioning, night_date, year, warmth AS x, sd_tmin AS y, clearness, wind, rh FROM nights, sp
          WHERE year <= 1998 AND sd_tmin IS NOT NULL AND (estimand <> 'within_regime' OR regime = conditioning)
            AND (NOT contains(conditioning, 'clearness') OR clearness IS NOT NULL))""",
       c.resid_sql("r", "b", "estimand, conditioning", ("clearness", "wind", "rh"), "night_date, year", _SIMPSON_USE),
       c.shift_sql("p", "r", "estimand, conditioning", 4)) + """
    SELECT estimand, conditioning, c.r, p_shift, n FROM p JOIN (SELECT estimand, conditioning, corr(rx, ry) r FROM r GROUP BY 1, 2) c
    USING (estimand, conditioning) WHERE estimand <> 'within_regime' OR n > 20""")
def simpson_decomposition(t: Tables) -> DataFrame:
    return studies.simpson(fixed_nights(t).where(in_dev()), "warmth", "sd_tmin")


@query("saturation_within_regime", "T12 Q3", "metric:s rho p_shift p_bh n:i", c.with_(c.NIGHTS, """
    b AS (SELECT * FROM (SELECT unnest(['sd_tmin', 'p90p10_tmin', 'iqr_tmin', 'sd_cool_rate', 'p90p10_cool_rate', 'sd_cool_total']) AS metric,
             unnest([sd_tmin, p90p10_tmin, iqr_tmin, sd_cool_rate, p90p10_cool_rate, sd_cool_total]) AS y, night_date, year, warmth AS x
           FROM nights WHERE regime = 'calm_clear' AND year <= 1998) WHERE y IS NOT NULL)""",
       c.resid_sql("r", "b", "metric", (), "night_date, year"), c.shift_sql("p", "r", "metric", 4), c.bh_sql("h", "(SELECT * FROM p WHERE n >= 20)", "p_shift")) + """
    SELECT metric, c.rho, p_shift, p_bh, n FROM h JOIN (SELECT metric, corr(rx, ry) rho FROM r GROUP BY 1) c USING (metric)""")
def saturation_within_regime(t: Tables) -> DataFrame:
    return studies.saturation(fixed_nights(t).where(in_dev()), "warmth")


@query("cooling_mechanism", "T8 Q3", "outcome:s beta se p r2 n:i", c.with_(c.NIGHTS, """
    b AS (SELECT * FROM (SELECT unnest(['sd_cool_rate', 'mean_cool_rate', 'sd_tmin']) AS outcome, unnest([sd_cool_rate, mean_cool_rate, sd_tmin]) AS y,
             night_date, warmth FROM nights WHERE regime = 'calm_clear') WHERE y IS NOT NULL)""", c.hac_sql("h", "b", "outcome", "y", "warmth", 7)) + "SELECT * FROM h")
def cooling_mechanism(t: Tables) -> DataFrame:
    return studies.mechanism(m.nights(t), "warmth")


@query("regime_descriptives", "Q3 A1", "regime:s n:i mean_warmth mean_sd mean_wind mean_rad", c.with_(c.NIGHTS) + """
    SELECT regime, count(*) AS n, avg(warmth) AS mean_warmth, avg(sd_tmin) AS mean_sd, avg(wind) AS mean_wind, avg(day_rad) AS mean_rad
    FROM nights WHERE year <= 1998 GROUP BY regime""")
def regime_descriptives(t: Tables) -> DataFrame:
    return m.nights(t).where(in_dev()).groupBy("regime").agg(
        F.count("*").alias("n"), F.avg("warmth").alias("mean_warmth"), F.avg("sd_tmin").alias("mean_sd"),
        F.avg("wind").alias("mean_wind"), F.avg("day_rad").alias("mean_rad"))


# Development estimates and predicted outcomes used as the reference of the held-out family.
REFERENCE = {"H1": (0.4, "direction"), "H2": (0.1, "direction"), "H3": (0.3, "direction"), "H4": (-0.2, "direction"), "H5": (0.1, "null")}


def _hypotheses_sql(regime: str, extra: str) -> str:
    use = {v: "id = 'H2'" for v in ("day_rad", "clearness", "wind")}
    return c.with_(c.NIGHTS, extra, f"""
    b AS (SELECT * FROM (SELECT i AS id, night_date, year, warmth AS x, CASE WHEN i = 'H3' THEN sd_cool_total ELSE sd_tmin END AS y, day_rad, clearness, wind
           FROM hn, (VALUES ('H1'), ('H2'), ('H3')) v(i) WHERE year >= 1999 AND (i = 'H2' OR {regime} = 'calm_clear'))
          WHERE y IS NOT NULL AND (id <> 'H2' OR clearness IS NOT NULL)),
    b2 AS (SELECT * FROM (SELECT i AS id, night_date, warmth, CASE WHEN i = 'H4' THEN mean_cool_rate ELSE sd_cool_rate END AS y
           FROM hn, (VALUES ('H4'), ('H5')) v(i) WHERE year >= 1999 AND {regime} = 'calm_clear') WHERE y IS NOT NULL)""",
        c.resid_sql("r", "b", "id", ("day_rad", "clearness", "wind"), "night_date, year", use), c.shift_sql("p", "r", "id", 3),
        c.hac_sql("h", "b2", "id", "y", "warmth", 7), """
    u AS (SELECT id, c.e AS estimate, p_shift AS p_raw, n FROM p JOIN (SELECT id, corr(rx, ry) e FROM r GROUP BY 1) c USING (id)
          UNION ALL SELECT id, beta, p, n FROM h)""", c.bh_sql("bh", "u", "p_raw")) + """
    SELECT id, estimate, p_raw, n, p_bh, CASE WHEN id = 'H5' THEN CASE WHEN p_bh >= 0.05 THEN 'null_kept' ELSE 'null_rejected' END
      WHEN sign(estimate) = sign(d) AND p_bh < 0.05 THEN 'held_significant' WHEN sign(estimate) = sign(d) THEN 'held'
      ELSE 'reversed' END AS verdict
    FROM bh JOIN (VALUES ('H1', 0.4), ('H2', 0.1), ('H3', 0.3), ('H4', -0.2), ('H5', 0.1)) v(id, d) USING (id)"""


@query("holdout_hypotheses", "T13 P27 Q4", "id:s estimate p_raw n:i p_bh verdict:s", _hypotheses_sql("regime", "hn AS (SELECT * FROM nights)"))
def holdout_hypotheses(t: Tables) -> DataFrame:
    return studies.hypotheses(fixed_nights(t).where(F.col("year").isin(list(m.HOLDOUT_YEARS))), "warmth", "regime", REFERENCE)


@query("holdout_hypotheses_other_source", "T13 Q6", "id:s estimate p_raw n:i p_bh verdict:s", _hypotheses_sql("regime2", """
    hk AS (SELECT round(quantile_cont(day_rad, 1.0/3), 9) a, round(quantile_cont(day_rad, 2.0/3), 9) b FROM nights WHERE year <= 1998),
    hn AS (SELECT n.*, CASE WHEN day_rad >= b THEN 'calm_clear' WHEN day_rad <= a THEN 'cloudy_windy' ELSE 'mixed' END AS regime2 FROM nights n, hk)"""))
def holdout_hypotheses_other_source(t: Tables) -> DataFrame:
    n = scalars.label_by_quantiles(fixed_nights(t), "day_rad", (1 / 3, 2 / 3), F.col("year") <= 1998,
                                   ("cloudy_windy", "mixed", "calm_clear"), "regime2")
    return studies.hypotheses(n.where(F.col("year").isin(list(m.HOLDOUT_YEARS))), "warmth", "regime2", REFERENCE)


WINDOWS = {"20-08": (20, 8, 1), "21-07": (21, 7, 1), "22-06": (22, 6, 1)}


def spec_layers(t: Tables) -> DataFrame:
    w = m.weather(t).select("night_date", "calm_clear_index", *studies.COVARIATES)
    return settled(panel.window_layers(m.slots(t), WINDOWS, 3).join(w, "night_date").withColumn("year", F.year("night_date")))


def _sets_sql() -> str:
    return ", ".join(f"('{k}')" for k in studies.ADJUSTMENT_SETS)


_USE = {cov: "adjustment_set IN (" + ", ".join(f"'{k}'" for k, v in studies.ADJUSTMENT_SETS.items() if cov in v) + ")" for cov in studies.COVARIATES}


def _curve_sql(layers: str, by: str, outcomes, min_n: int) -> str:
    keys = f"{by}, cut, outcome, adjustment_set, years, sample"
    need = " AND ".join(f"(NOT ({_USE[v]}) OR {v} IS NOT NULL)" for v in studies.COVARIATES)
    return c.with_(c.SLOTS, c.WEATHER, layers, f"""
    th AS (SELECT {by}, round(quantile_cont(calm_clear_index, 2.0/3), 9) h1, round(quantile_cont(calm_clear_index, 0.75), 9) h2,
                  round(quantile_cont(calm_clear_index, 0.8), 9) h3 FROM layers WHERE year <= 1998 GROUP BY {by}),
    smp AS (SELECT l.*, s.* FROM layers l JOIN th USING ({by}), LATERAL (VALUES ('all_nights', 'any', true), ('calm_clear_only', '33/67', calm_clear_index >= h1),
            ('calm_clear_only', '25/75', calm_clear_index >= h2), ('calm_clear_only', '20/80', calm_clear_index >= h3)) s(sample, cut, inside) WHERE inside),
    yrs AS (SELECT smp.*, y.years FROM smp, (VALUES ('all', 1995, 2001), ('dev', 1995, 1998), ('holdout', 1999, 2001)) y(years, y0, y1) WHERE year BETWEEN y0 AND y1),
    b AS (SELECT * FROM (SELECT {by}, cut, years, sample, warmth, unnest([{', '.join(repr(o) for o in outcomes)}]) AS outcome, unnest([{', '.join(outcomes)}]) AS y,
           day_rad, clearness, wind, precip FROM yrs), (VALUES {_sets_sql()}) a(adjustment_set) WHERE y IS NOT NULL AND {need})""",
        c.partial_sql("d", "b", keys, "warmth", "y", studies.COVARIATES, min_n, use=_USE))


_LAYERS = ", ".join(
    c.station_nights(f"sn{i}", a, b) + ", " + c.city_nights(f"ct{i}", f"sn{i}") for i, (a, b, _) in enumerate(WINDOWS.values())
) + ", layers AS MATERIALIZED (SELECT l.*, w.* EXCLUDE (night_date), year(l.night_date) AS year FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS win, night_date, warmth, sd_tmin, p90p10_tmin, iqr_tmin FROM ct{i}" for i, name in enumerate(WINDOWS)
) + ") l JOIN weather w USING (night_date))"


@query("specification_curve", "T14 J6 Q5", "win:s cut:s outcome:s adjustment_set:s years:s sample:s rho n:i",
       _curve_sql(_LAYERS, "win", studies.SPREADS, 30) + """
    SELECT win, k.cut AS cut, outcome, adjustment_set, years, sample, rho, n FROM d JOIN (VALUES ('33/67'), ('25/75'), ('20/80')) k(cut)
      ON d.cut = 'any' OR d.cut = k.cut WHERE rho IS NOT NULL""")
def specification_curve(t: Tables) -> DataFrame:
    return studies.spec_curve(studies.distinct_spec_curve(spec_layers(t), m.DEV_YEARS, m.HOLDOUT_YEARS, studies.SPREADS))


@query("distinct_specifications", "T15 J16 J17 Q19", "sample:s years:s n_specs:i median_rho", _curve_sql(_LAYERS, "win", studies.SPREADS, 30) + """
    SELECT sample, years, count(*) AS n_specs, quantile_cont(rho, 0.5) AS median_rho FROM d WHERE rho IS NOT NULL GROUP BY 1, 2""")
def distinct_specifications(t: Tables) -> DataFrame:
    d = studies.distinct_spec_curve(spec_layers(t), m.DEV_YEARS, m.HOLDOUT_YEARS, studies.SPREADS).where(F.col("rho").isNotNull())
    return d.groupBy("sample", "years").agg(F.count("*").alias("n_specs"), F.percentile("rho", F.lit(0.5)).alias("median_rho"))


@query("specification_factor_summary", "A15 Q5", "factor:s level:s median min max size:i", _curve_sql(_LAYERS, "win", studies.SPREADS, 30) + """,
    f AS (SELECT win, k.cut AS cut, outcome, adjustment_set, years, sample, rho FROM d JOIN (VALUES ('33/67'), ('25/75'), ('20/80')) k(cut)
      ON d.cut = 'any' OR d.cut = k.cut WHERE rho IS NOT NULL),
    l AS (SELECT rho, unnest(['adjustment_set', 'outcome', 'win', 'cut', 'sample', 'years']) AS factor, unnest([adjustment_set, outcome, win, cut, sample, years]) AS level FROM f)
    SELECT factor, level, quantile_cont(rho, 0.5) AS median, min(rho) AS min, max(rho) AS max, count(*) AS size FROM l GROUP BY 1, 2""")
def specification_factor_summary(t: Tables) -> DataFrame:
    curve = studies.spec_curve(studies.distinct_spec_curve(spec_layers(t), m.DEV_YEARS, m.HOLDOUT_YEARS, studies.SPREADS))
    return ag.by_factor(curve, ["adjustment_set", "outcome", "win", "cut", "sample", "years"], "rho")


OUTCOMES = ("sd_tmin", "sd_cool_total", "sd_cool_rate", "mean_cool_rate")
_NIGHT_LAYER = c.station_nights() + ", " + c.city_nights() + """, layers AS MATERIALIZED (
    SELECT 'base' AS win, c.*, w.* EXCLUDE (night_date), year(c.night_date) AS year FROM city c JOIN weather w USING (night_date))"""


@query("observable_stability", "T16 A25 Q7", "outcome:s median_est min_est max_est iqr sign_consistency median_range n_specs:i",
       _curve_sql(_NIGHT_LAYER, "win", OUTCOMES, 30) + """,
    f AS (SELECT outcome, adjustment_set, rho FROM d JOIN (VALUES ('33/67'), ('25/75'), ('20/80')) k(cut) ON d.cut = 'any' OR d.cut = k.cut WHERE rho IS NOT NULL),
    m AS (SELECT outcome, max(q) - min(q) AS median_range FROM (SELECT outcome, adjustment_set, quantile_cont(rho, 0.5) q FROM f GROUP BY 1, 2) GROUP BY 1)
    SELECT outcome, quantile_cont(rho, 0.5) AS median_est, min(rho) AS min_est, max(rho) AS max_est, quantile_cont(rho, 0.75) - quantile_cont(rho, 0.25) AS iqr,
           greatest(avg((rho > 0)::INT), avg((rho < 0)::INT)) AS sign_consistency, max(median_range) AS median_range, count(*) AS n_specs
    FROM f JOIN m USING (outcome) GROUP BY outcome""")
def observable_stability(t: Tables) -> DataFrame:
    d = studies.distinct_spec_curve(fixed_nights(t).withColumn("win", F.lit("base")), m.DEV_YEARS, m.HOLDOUT_YEARS, OUTCOMES)
    return ag.sign_consistency(studies.spec_curve(d), "outcome", "rho", "adjustment_set")


@query("confounder_screen", "T17 A23", "a:s b:s r n:i", c.with_(c.NIGHTS) + f""",
    l AS (SELECT * FROM (SELECT unnest(['warmth|sd_tmin', 'warmth|day_rad', 'warmth|clearness', 'sd_tmin|day_rad', 'sd_tmin|clearness', 'day_rad|clearness']) AS k,
            unnest([warmth, warmth, warmth, sd_tmin, sd_tmin, day_rad]) AS x, unnest([sd_tmin, day_rad, clearness, day_rad, clearness, clearness]) AS y
          FROM nights WHERE year <= 1998) WHERE x IS NOT NULL AND y IS NOT NULL),
    r AS (SELECT k, {c.rank_avg('x', 'k')} rx, {c.rank_avg('y', 'k')} ry FROM l)
    SELECT split_part(k, '|', 1) AS a, split_part(k, '|', 2) AS b, corr(rx, ry) AS r, count(*) AS n FROM r GROUP BY k""")
def confounder_screen(t: Tables) -> DataFrame:
    return at.corr_matrix(m.nights(t).where(in_dev()), ["warmth", "sd_tmin", "day_rad", "clearness"])


@query("indicator_correlations", "A23 R15", "a:s b:s r n:i", c.with_(c.SCREEN) + f""",
    r AS (SELECT {c.rank_avg('heat_gp')} a, {c.rank_avg('older')} b, {c.rank_avg('canopy')} c, {c.rank_avg('building')} d FROM cells)
    SELECT unnest(['heat_gp', 'heat_gp', 'heat_gp', 'older', 'older', 'canopy']) AS a, unnest(['older', 'canopy', 'building', 'canopy', 'building', 'building']) AS b,
           unnest([corr(a, b), corr(a, c), corr(a, d), corr(b, c), corr(b, d), corr(c, d)]) AS r, unnest([count(*), count(*), count(*), count(*), count(*), count(*)]) AS n FROM r""")
def indicator_correlations(t: Tables) -> DataFrame:
    return at.corr_matrix_any_size(m.screen_cells(t), ["heat_gp", "older", "canopy", "building"])


@query("profile_dropout_reasons", "T32 A3", "reason:s n:i mean_ratio", c.with_(PROFILE) + """,
    s AS (SELECT *, first_value(hbin) OVER (PARTITION BY night_date ORDER BY sd DESC, hbin) AS pk FROM prof WHERE hbin BETWEEN 0 AND 6),
    g AS (SELECT night_date, count(*) = 25 AS complete, max(sd) AS peak_sd,
          CASE WHEN count(*) FILTER (hbin >= pk) >= 4 THEN regr_slope(sd, hbin) FILTER (hbin >= pk) END AS slope, avg(mean) AS driver FROM s GROUP BY night_date)
    SELECT CASE WHEN NOT complete THEN 'incomplete_window' WHEN slope IS NULL THEN 'late_peak' WHEN driver IS NULL THEN 'missing_driver' ELSE 'kept' END AS reason,
           count(*) AS n, avg(slope / peak_sd) AS mean_ratio FROM g GROUP BY 1""")
def profile_dropout_reasons(t: Tables) -> DataFrame:
    p = settled(sunset_profile(t).where(F.col("hbin").between(0.0, 6.0)))
    g = series.complete(p, "night_date", "hbin", 0.0, 6.0).join(series.tail_slope(p, "night_date", "hbin", "sd"), "night_date").join(
        p.groupBy("night_date").agg(F.max("sd").alias("peak_sd"), F.avg("mean").alias("driver")), "night_date")
    r = studies.retention(g, ["driver"])
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.avg(F.col("tail_slope") / F.col("peak_sd")).alias("mean_ratio"))


@query("retention_association", "T32 T2", "rho n:i", c.with_(PROFILE) + f""",
    s AS (SELECT *, first_value(hbin) OVER (PARTITION BY night_date ORDER BY sd DESC, hbin) AS pk FROM prof WHERE hbin BETWEEN 0 AND 6),
    g AS (SELECT night_date, max(sd) AS peak_sd, CASE WHEN count(*) FILTER (hbin >= pk) >= 4 THEN regr_slope(sd, hbin) FILTER (hbin >= pk) END AS slope, avg(mean) AS level FROM s GROUP BY night_date),
    k AS (SELECT round(slope / peak_sd, 9) AS ratio, round(level, 9) AS level FROM g WHERE slope IS NOT NULL AND peak_sd > 0)
    SELECT corr(a, b) AS rho, count(*) AS n FROM (SELECT {c.rank_avg('ratio')} a, {c.rank_avg('level')} b FROM k)""")
def retention_association(t: Tables) -> DataFrame:
    """Rank correlation of the retention ratio (decay over peak) with the level of the night."""
    p = settled(sunset_profile(t).where(F.col("hbin").between(0.0, 6.0)))
    g = series.tail_slope(p, "night_date", "hbin", "sd").join(p.groupBy("night_date").agg(F.max("sd").alias("peak_sd"), F.avg("mean").alias("level")), "night_date")
    k = g.where("tail_slope IS NOT NULL AND peak_sd > 0").select(F.round(F.col("tail_slope") / F.col("peak_sd"), 9).alias("ratio"), F.round("level", 9).alias("level"))
    return at.spearman(k, "ratio", "level")


@query("paired_partial_residuals", "T29 P22", "night_date:d y_resid x_resid", c.with_(c.NIGHTS, """
    k AS (SELECT night_date, sd_tmin, warmth, day_rad, wind, rh FROM nights WHERE sd_tmin IS NOT NULL AND warmth IS NOT NULL AND day_rad IS NOT NULL AND wind IS NOT NULL AND rh IS NOT NULL)""",
       c.linear_resid_sql("r", "k", ["sd_tmin", "warmth"], ["day_rad", "wind", "rh"], keep="night_date")) + "SELECT night_date, sd_tmin AS y_resid, warmth AS x_resid FROM r")
def paired_partial_residuals(t: Tables) -> DataFrame:
    return rg.partial_residuals(fixed_nights(t), "sd_tmin", "warmth", ["day_rad", "wind", "rh"])
