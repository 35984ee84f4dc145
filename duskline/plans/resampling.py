"""Bootstraps and censored-time reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.functions import counter, solar
from duskline.functions import timeparts as tp
from duskline.operators import aggregates as ag
from duskline.operators import joins, panel, ranks, scalars, series, survival
from duskline.operators import regression as rg
from duskline.operators import resample as rs
from duskline.plans import ctes as c
from duskline.plans.associations import fixed_nights
from duskline.plans.basics import DUSK, PROFILE, since_sunset, sun_cte, sunset_profile
from duskline.plans.registry import query
from duskline.session import settled
from duskline.sources import mapping as m
from duskline.sources.tables import Tables


def terciles(n: DataFrame) -> DataFrame:
    """Calm-clear nights by warmth tercile."""
    cc = n.where(F.col("regime") == "calm_clear")
    return scalars.label_by_quantiles(cc, "warmth", (1 / 3, 2 / 3), F.lit(True), ("cool", "middle", "hot"), "tercile")


TERC = """tc AS (SELECT round(quantile_cont(warmth, 1.0/3), 9) a, round(quantile_cont(warmth, 2.0/3), 9) b FROM nights WHERE regime = 'calm_clear'),
  terc AS (SELECT n.*, CASE WHEN warmth >= b THEN 'hot' WHEN warmth <= a THEN 'cool' ELSE 'middle' END AS tercile FROM nights n, tc WHERE regime = 'calm_clear')"""

#: Replicates: of year clusters for a group difference, of clusters otherwise, of calendar blocks and stationary series.
DIFFERENCE, CLUSTERS, BLOCKS = 5000, 2000, 3000

CI = "quantile_cont({v}, 0.025) AS ci_low, quantile_cont({v}, 0.975) AS ci_high"


@query("counter_draws", "R4", "year:i below:i unit normal", c.with_(c.NIGHTS) + f"""
    SELECT year, {c.draw('a', 'year')} % 92 AS below, {c.draw('b', 'year')} / 268435456.0::DOUBLE AS unit, {c.normal_draw('n', 'year')} AS normal
    FROM (SELECT DISTINCT year FROM nights)""")
def counter_draws(t: Tables) -> DataFrame:
    return m.nights(t).select("year").distinct().select(
        "year", counter.draw_below(F.lit(92), "a", "year").alias("below"), counter.draw_unit("b", "year").alias("unit"),
        counter.draw_normal("n", "year").alias("normal"))


@query("cluster_bootstrap_difference", "R1", "diff ci_low ci_high p_boot n_hi:i n_lo:i", c.with_(c.NIGHTS, c.cluster_draws("d", "q", "year", DIFFERENCE, "r1").replace(
    "d_i AS", """q AS (SELECT * FROM nights WHERE regime IN ('calm_clear', 'cloudy_windy') AND sd_tmin IS NOT NULL),
    st AS (SELECT year, sum(CASE WHEN regime = 'calm_clear' THEN sd_tmin ELSE 0 END) sh, count(*) FILTER (regime = 'calm_clear') nh,
                  sum(CASE WHEN regime <> 'calm_clear' THEN sd_tmin ELSE 0 END) sl, count(*) FILTER (regime <> 'calm_clear') nl FROM q GROUP BY year),
    d_i AS""", 1)) + f""",
    b AS (SELECT replicate, round(sum(times * sh) / sum(times * nh) - sum(times * sl) / sum(times * nl), 9) AS d FROM d JOIN st USING (year) GROUP BY replicate)
    SELECT (SELECT sum(sh) / sum(nh) - sum(sl) / sum(nl) FROM st) AS diff, {CI.format(v='d')},
           least(1, greatest(2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)), 1.0::DOUBLE / (count(*) + 1))) AS p_boot,
           (SELECT sum(nh) FROM st) AS n_hi, (SELECT sum(nl) FROM st) AS n_lo FROM b""")
def cluster_bootstrap_difference(t: Tables) -> DataFrame:
    return rs.cluster_boot_diff(fixed_nights(t), "sd_tmin", "regime", "calm_clear", "cloudy_windy", "year", DIFFERENCE, "r1")


@query("cluster_bootstrap_mean", "R2 T24", "tercile:s mean n:i ci_low ci_high", c.with_(c.NIGHTS, TERC, """
    st AS (SELECT tercile, year, sum(sd_tmin) s, count(*) n FROM terc WHERE sd_tmin IS NOT NULL GROUP BY 1, 2)""",
       c.cluster_draws("d", "st", "year", CLUSTERS, "r2", "tercile")) + f""",
    b AS (SELECT tercile, replicate, sum(times * s) / sum(times * n) AS m FROM d JOIN st USING (tercile, year) GROUP BY 1, 2)
    SELECT tercile, (SELECT sum(s) / sum(n) FROM st x WHERE x.tercile = b.tercile) AS mean, (SELECT sum(n) FROM st x WHERE x.tercile = b.tercile) AS n,
           {CI.format(v='m')} FROM b GROUP BY tercile""")
def cluster_bootstrap_mean(t: Tables) -> DataFrame:
    return rs.cluster_boot_mean(terciles(fixed_nights(t)), "sd_tmin", "year", ["tercile"], CLUSTERS, "r2")


@query("cluster_bootstrap_rank_correlation", "R3", "regime:s estimate n:i ci_low ci_high", c.with_(c.NIGHTS, """
    q AS (SELECT regime, year, warmth AS x, sd_tmin AS y FROM nights WHERE sd_tmin IS NOT NULL)""", c.cluster_draws("d", "q", "year", CLUSTERS, "r3", "regime")) + f""",
    e AS (SELECT regime, replicate, x, y FROM (SELECT q.*, d.replicate, unnest(range(times)) AS t FROM q JOIN d USING (regime, year))),
    r AS (SELECT regime, replicate, x, {c.rank_avg('x', 'regime, replicate')} rx, {c.rank_avg('y', 'regime, replicate')} ry FROM e),
    b AS (SELECT regime, replicate, CASE WHEN count(DISTINCT x) > 5 THEN corr(rx, ry) END AS rho FROM r GROUP BY 1, 2),
    o AS (SELECT regime, corr(a, b) AS estimate, count(*) AS n FROM (SELECT regime, {c.rank_avg('x', 'regime')} a, {c.rank_avg('y', 'regime')} b FROM q) GROUP BY 1)
    SELECT regime, estimate, n, ci_low, ci_high FROM o JOIN (SELECT regime, {CI.format(v='rho')} FROM b GROUP BY 1) USING (regime)""")
def cluster_bootstrap_rank_correlation(t: Tables) -> DataFrame:
    return rs.cluster_boot_stat(fixed_nights(t), "warmth", "sd_tmin", "year", CLUSTERS, "r3", ["regime"])


@query("cluster_bootstrap_slope", "R3", "regime:s estimate n:i ci_low ci_high", c.with_(c.NIGHTS, """
    q AS (SELECT regime, year, warmth AS x, sd_tmin AS y FROM nights WHERE sd_tmin IS NOT NULL)""", c.cluster_draws("d", "q", "year", CLUSTERS, "r3", "regime")) + f""",
    b AS (SELECT regime, replicate, regr_slope(y, x) AS s FROM (SELECT q.*, d.replicate, unnest(range(times)) AS t FROM q JOIN d USING (regime, year)) GROUP BY 1, 2)
    SELECT regime, estimate, n, ci_low, ci_high FROM (SELECT regime, regr_slope(y, x) AS estimate, count(*) AS n FROM q GROUP BY 1)
    JOIN (SELECT regime, {CI.format(v='s')} FROM b GROUP BY 1) USING (regime)""")
def cluster_bootstrap_slope(t: Tables) -> DataFrame:
    return rs.cluster_boot_stat(fixed_nights(t), "warmth", "sd_tmin", "year", CLUSTERS, "r3", ["regime"], stat="slope")


def scoped_calendar(t: Tables, nights: DataFrame) -> DataFrame:
    """The calendar once per analysis scope (development, evaluation, all)."""
    cal = panel.with_calendar(nights, m.calendar(t), "night_date")
    from duskline.operators.association import spec_rows

    return spec_rows(cal, [{"scope": "all"}, {"scope": "development", "where": F.col("year").isin(list(m.DEV_YEARS))},
                           {"scope": "evaluation", "where": F.col("year").isin(list(m.HOLDOUT_YEARS))}])


SCOPED = """cal AS MATERIALIZED (SELECT k.year, k.night_date, k.day_index, n.* EXCLUDE (year, night_date), s.scope FROM calendar k LEFT JOIN nights n USING (night_date),
    (VALUES ('all', 1995, 2001), ('development', 1995, 1998), ('evaluation', 1999, 2001)) s(scope, y0, y1) WHERE k.year BETWEEN y0 AND y1)"""


@query("calendar_block_bootstrap", "R4 Q16 Q22", "scope:s rho n:i ci_low ci_high n_valid:i", c.with_(c.NIGHTS, c.CALENDAR, SCOPED,
       c.block_draws("bd", "cal", BLOCKS, "r4", by="scope"), """
    k AS (SELECT scope, year, day_index, warmth, sd_tmin FROM cal WHERE regime = 'calm_clear' AND sd_tmin IS NOT NULL),
    e AS (SELECT scope, replicate, warmth, sd_tmin FROM (SELECT k.*, replicate, unnest(range(times)) FROM bd JOIN k USING (scope, year, day_index)))""",
       c.partial_sql("b", "e", "scope, replicate", "warmth", "sd_tmin", (), 8), c.partial_sql("o", "k", "scope", "warmth", "sd_tmin", (), 8)) + f"""
    SELECT scope, o.rho, o.n, CASE WHEN n_valid >= {BLOCKS // 2} THEN ci_low END AS ci_low, CASE WHEN n_valid >= {BLOCKS // 2} THEN ci_high END AS ci_high, n_valid FROM o JOIN (SELECT scope, {CI.format(v='rho')}, count(rho) AS n_valid FROM b GROUP BY 1) USING (scope)""")
def calendar_block_bootstrap(t: Tables) -> DataFrame:
    return rs.block_boot(scoped_calendar(t, fixed_nights(t)), "warmth", "sd_tmin", F.col("regime") == "calm_clear", BLOCKS, "r4", by=["scope"])


_SEASONAL = ("season", "season_sq", *[f"year_{y}" for y in m.YEARS[1:]])
_FIRST_YEAR = {"all": m.YEARS[0], "development": m.DEV_YEARS[0], "evaluation": m.HOLDOUT_YEARS[0]}
_DUMMIES = ", ".join(f"(k.year = {y} AND k.year > s.y0)::INT AS year_{y}" for y in m.YEARS[1:])
_RAW_SQL = f"""cal AS MATERIALIZED (SELECT s.scope, k.year, k.day_index, n.* EXCLUDE (year, night_date), (dayofyear(k.night_date) - 196.5) / 30.0 AS season,
    ((dayofyear(k.night_date) - 196.5) / 30.0) ** 2 AS season_sq, {_DUMMIES} FROM calendar k LEFT JOIN nights n USING (night_date),
    (VALUES ('all', 1995, 2001), ('development', 1995, 1998), ('evaluation', 1999, 2001)) s(scope, y0, y1) WHERE k.year BETWEEN s.y0 AND s.y1)"""


@query("season_adjusted_block_bootstrap", "R4 T3", "scope:s rho n:i ci_low ci_high", c.with_(c.NIGHTS, c.CALENDAR, _RAW_SQL, c.block_draws("bd", "cal", BLOCKS, "r4b", by="scope"), f"""
    k AS (SELECT scope, year, day_index, warmth, sd_tmin, {', '.join(_SEASONAL)} FROM cal WHERE regime = 'calm_clear' AND sd_tmin IS NOT NULL),
    e AS (SELECT * EXCLUDE (t) FROM (SELECT k.*, replicate, unnest(range(times)) AS t FROM bd JOIN k USING (scope, year, day_index)))""",
       c.partial_sql("b", "e", "scope, replicate", "warmth", "sd_tmin", _SEASONAL, 8, raw=_SEASONAL), c.partial_sql("o", "k", "scope", "warmth", "sd_tmin", _SEASONAL, 8, raw=_SEASONAL)) + f"""
    SELECT scope, o.rho, o.n, ci_low, ci_high FROM o JOIN (SELECT scope, {CI.format(v='rho')} FROM b GROUP BY 1) USING (scope)""")
def season_adjusted_block_bootstrap(t: Tables) -> DataFrame:
    cal = scoped_calendar(t, fixed_nights(t))
    s, s2 = tp.season_terms(F.dayofyear("night_date"))
    cal = scalars.one_hot(cal.withColumns({"season": s, "season_sq": s2}), "year", m.YEARS)
    base = F.create_map(*[F.lit(v) for kv in _FIRST_YEAR.items() for v in kv])[F.col("scope")]
    cal = cal.withColumns({f"year_{y}": F.when(base == y, 0).otherwise(F.col(f"year_{y}")) for y in m.YEARS[1:]})
    return rs.block_boot(cal, "warmth", "sd_tmin", F.col("regime") == "calm_clear", BLOCKS, "r4b", covs=_SEASONAL, raw=_SEASONAL, by=["scope"])


def hour_profile(t: Tables, n: DataFrame) -> DataFrame:
    """Cross-station SD per night and hour after 20:00 of the multi-year panel."""
    s = panel.with_night(m.slots(t), "loc_ts", 20, 8).join(n.select("night_date"), "night_date", "left_semi")
    off = tp.snap(tp.hours_since("loc_ts", F.timestamp_add("HOUR", F.lit(20), F.col("night_date").cast("timestamp_ntz"))))
    return panel.profile(s.withColumn("offset_h", off), "offset_h", 2, collapse=True)


HOURS = """hp AS (SELECT night_date, offset_h, round(stddev_samp(value), 9) AS sd, count(*) AS n FROM (
    SELECT night_date, round_even((epoch_us(loc_ts) - epoch_us(night_date::TIMESTAMP + INTERVAL 20 HOUR)) / 3.6e9 * 4, 0)::DOUBLE / 4 AS offset_h, station, avg(value) AS value
    FROM (SELECT *, CASE WHEN hour(loc_ts) >= 20 THEN CAST(loc_ts AS DATE) ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS night_date FROM slots)
    WHERE night_date IN (SELECT night_date FROM nights) GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("block_bootstrap_curves", "R5 T26 Q22", "tercile:s offset_h mean n_nights:i ci_low ci_high", c.with_(c.NIGHTS, c.CALENDAR, TERC, HOURS,
       c.block_draws("bd", "calendar", BLOCKS, "r5")) + f""",
    tn AS (SELECT k.year, k.day_index, night_date, tercile FROM calendar k JOIN terc USING (night_date)),
    b AS (SELECT tercile, offset_h, replicate, sum(times * sd) / sum(times) AS mm FROM bd JOIN tn USING (year, day_index) JOIN hp USING (night_date) WHERE sd IS NOT NULL GROUP BY 1, 2, 3)
    SELECT tercile, offset_h, mean, n_nights, ci_low, ci_high FROM (SELECT tercile, offset_h, avg(sd) AS mean, count(*) AS n_nights FROM hp JOIN tn USING (night_date) GROUP BY 1, 2)
    JOIN (SELECT tercile, offset_h, {CI.format(v='mm')} FROM b GROUP BY 1, 2) USING (tercile, offset_h)""")
def block_bootstrap_curves(t: Tables) -> DataFrame:
    n = fixed_nights(t)
    cal = panel.with_calendar(terciles(n).select("night_date", "tercile"), m.calendar(t), "night_date")
    return rs.block_boot_curve(cal, settled(hour_profile(t, n)), "tercile", "offset_h", "sd", BLOCKS, "r5")


def slots_since_sunset(t: Tables) -> DataFrame:
    """Slots of the multi-year panel with their night and hours since that evening's sunset."""
    days = m.calendar(t).select("night_date")
    sun = days.withColumn("sunset_local", tp.to_local(solar.sunset_utc("night_date", m.LAT, m.LON), m.TZ))
    s = panel.with_night(m.slots(t), "loc_ts", 20, 8)
    return s.join(sun, "night_date").withColumn("since", tp.hours_since("loc_ts", "sunset_local"))


SINCE = "kd AS (SELECT night_date AS d FROM calendar), " + sun_cte("kd") + """,
    ss AS (SELECT s.*, (epoch_us(loc_ts) - epoch_us(sunset_local)) / 3.6e9 AS since
           FROM (SELECT *, CASE WHEN hour(loc_ts) >= 20 THEN CAST(loc_ts AS DATE) ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS night_date FROM slots
                 WHERE hour(loc_ts) >= 20 OR hour(loc_ts) < 8) s JOIN sunset USING (night_date))"""
SUNSET_HOURS = SINCE + """, hp AS (SELECT night_date, offset_h, round(stddev_samp(value), 9) AS sd, count(*) AS n FROM (
    SELECT night_date, round_even(since * 4, 0)::DOUBLE / 4 AS offset_h, station, avg(value) AS value FROM ss WHERE since BETWEEN -2.125 AND 9.125
    AND night_date IN (SELECT night_date FROM nights) GROUP BY 1, 2, 3) WHERE offset_h BETWEEN -2 AND 9 GROUP BY 1, 2 HAVING count(*) >= 2)"""


def sunset_hour_profile(t: Tables, n: DataFrame) -> DataFrame:
    """Cross-station SD per night and quarter hour since sunset, from two hours before to nine after."""
    s = slots_since_sunset(t).join(n.select("night_date"), "night_date", "left_semi").withColumn("offset_h", tp.snap("since"))
    return panel.profile(s.where(F.col("offset_h").between(-2.0, 9.0)), "offset_h", 2, collapse=True)


@query("block_bootstrap_curves_sunset", "R5 T26 Q22 Q8", "tercile:s offset_h mean n_nights:i ci_low ci_high", c.with_(c.NIGHTS, c.CALENDAR, TERC, SUNSET_HOURS,
       c.block_draws("bd", "calendar", BLOCKS, "r5s")) + f""",
    tn AS (SELECT k.year, k.day_index, night_date, tercile FROM calendar k JOIN terc USING (night_date)),
    b AS (SELECT tercile, offset_h, replicate, sum(times * sd) / sum(times) AS mm FROM bd JOIN tn USING (year, day_index) JOIN hp USING (night_date) WHERE sd IS NOT NULL GROUP BY 1, 2, 3)
    SELECT tercile, offset_h, mean, n_nights, ci_low, ci_high FROM (SELECT tercile, offset_h, avg(sd) AS mean, count(*) AS n_nights FROM hp JOIN tn USING (night_date) GROUP BY 1, 2)
    JOIN (SELECT tercile, offset_h, {CI.format(v='mm')} FROM b GROUP BY 1, 2) USING (tercile, offset_h)""")
def block_bootstrap_curves_sunset(t: Tables) -> DataFrame:
    n = fixed_nights(t)
    cal = panel.with_calendar(terciles(n).select("night_date", "tercile"), m.calendar(t), "night_date")
    return rs.block_boot_curve(cal, settled(sunset_hour_profile(t, n)), "tercile", "offset_h", "sd", BLOCKS, "r5s")


@query("functional_curve_sunset", "T23 Q9 Q22", "level:s t predicted r2 n:i")
def functional_curve_sunset(t: Tables) -> DataFrame:
    """Spline curves of the dispersion against hours since sunset at three warmth levels."""
    n = fixed_nights(t)
    z = scalars.zscore(n.select("night_date", "warmth"), ["warmth"])
    cv = settled(sunset_hour_profile(t, n).join(z, "night_date").where(F.col("sd").isNotNull()))
    q = cv.agg(F.percentile("z_warmth", F.array(F.lit(0.1), F.lit(0.9)))).scalar()
    return rg.spline_curve(cv, "offset_h", "z_warmth", "sd", (-1.0, 0.0, 1.5, 3.0, 4.5), {"cool": F.get(q, F.lit(0)), "mean": F.lit(0.0), "hot": F.get(q, F.lit(1))}, [i / 2 for i in range(-2, 10)])


@query("tercile_profile_clock", "T26 R2 Q8", "tercile:s offset_h mean n:i ci_low ci_high", c.with_(c.NIGHTS, TERC, HOURS, """
    st AS (SELECT tercile, offset_h, t.year, sum(sd) s, count(*) n FROM hp JOIN terc t USING (night_date) WHERE sd IS NOT NULL GROUP BY 1, 2, 3)""",
       c.cluster_draws("d", "st", "year", CLUSTERS, "t26", "tercile, offset_h")) + f""",
    b AS (SELECT tercile, offset_h, replicate, sum(times * s) / sum(times * n) AS mm FROM d JOIN st USING (tercile, offset_h, year) GROUP BY 1, 2, 3)
    SELECT tercile, offset_h, mean, n, ci_low, ci_high FROM (SELECT tercile, offset_h, sum(s) / sum(n) AS mean, sum(n) AS n FROM st GROUP BY 1, 2)
    JOIN (SELECT tercile, offset_h, {CI.format(v='mm')} FROM b GROUP BY 1, 2) USING (tercile, offset_h)""")
def tercile_profile_clock(t: Tables) -> DataFrame:
    n = fixed_nights(t)
    p = hour_profile(t, n).join(terciles(n).select("night_date", "tercile", "year"), "night_date")
    return rs.cluster_boot_mean(p, "sd", "year", ["tercile", "offset_h"], CLUSTERS, "t26")


@query("block_bootstrap_regression", "R6 Q16", "term:s estimate ci_low ci_high n:i n_valid:i")
def block_bootstrap_regression(t: Tables) -> DataFrame:
    z = scalars.zscore(fixed_nights(t), ["day_rad", "clearness", "wind", "rh"], ddof=0)
    cal = panel.with_calendar(z, m.calendar(t), "night_date")
    s, s2 = tp.season_terms(F.dayofyear("night_date"))
    cal = scalars.one_hot(cal.withColumns({"season": s, "season_sq": s2}), "year", m.YEARS)
    xs = ["warmth", "season", "season_sq", "z_day_rad", "z_clearness", "z_wind", "z_rh", *[f"year_{y}" for y in m.YEARS[1:]]]
    return rs.block_boot_ols(cal, "sd_tmin", xs, BLOCKS, "r6")


@query("block_bootstrap_regression_one_driver", "R6", "term:s estimate ci_low ci_high n:i", c.with_(c.NIGHTS, c.CALENDAR, c.block_draws("bd", "calendar", BLOCKS, "r6b"), """
    k AS (SELECT c.year, c.day_index, warmth, sd_tmin FROM calendar c JOIN nights USING (night_date) WHERE sd_tmin IS NOT NULL)""") + f""",
    e AS (SELECT k.*, replicate, unnest(range(times)) AS t FROM bd JOIN k USING (year, day_index)),
    b AS (SELECT replicate, unnest(['intercept', 'warmth']) AS term, unnest([regr_intercept(sd_tmin, warmth), regr_slope(sd_tmin, warmth)]) AS v FROM e GROUP BY 1)
    SELECT term, estimate, ci_low, ci_high, n FROM (SELECT unnest(['intercept', 'warmth']) AS term, unnest([regr_intercept(sd_tmin, warmth), regr_slope(sd_tmin, warmth)]) AS estimate,
      unnest([count(*), count(*)]) AS n FROM k) JOIN (SELECT term, {CI.format(v='v')} FROM b GROUP BY 1) USING (term)""")
def block_bootstrap_regression_one_driver(t: Tables) -> DataFrame:
    return rs.block_boot_ols(panel.with_calendar(fixed_nights(t), m.calendar(t), "night_date"), "sd_tmin", ["warmth"], BLOCKS, "r6b")


KNOTS = (0.0, 1.5, 3.0, 4.5, 6.0)


def warm_curve(t: Tables, n: DataFrame) -> DataFrame:
    z = scalars.zscore(n.select("night_date", "year", "warmth"), ["warmth"])
    return settled(hour_profile(t, n).join(z, "night_date").where(F.col("sd").isNotNull()))


@query("functional_curve", "T23 Q9", "level:s t predicted r2 n:i")
def functional_curve(t: Tables) -> DataFrame:
    cv = warm_curve(t, fixed_nights(t))
    q = cv.agg(F.percentile("z_warmth", F.array(F.lit(0.1), F.lit(0.9)))).scalar()
    levels = {"cool": F.get(q, F.lit(0)), "mean": F.lit(0.0), "hot": F.get(q, F.lit(1))}
    return rg.spline_curve(cv, "offset_h", "z_warmth", "sd", KNOTS, levels, [i / 2 for i in range(13)])


@query("functional_curve_bands", "R7 T23 Q9 Q22", "level:s t fit ci_low ci_high n_valid:i")
def functional_curve_bands(t: Tables) -> DataFrame:
    n = fixed_nights(t)
    cv = warm_curve(t, n)
    q = cv.agg(F.percentile("z_warmth", F.array(F.lit(0.1), F.lit(0.9)))).scalar()
    levels = {"cool": F.get(q, F.lit(0)), "mean": F.lit(0.0), "hot": F.get(q, F.lit(1))}
    return rs.block_boot_spline(m.calendar(t), cv, "offset_h", "z_warmth", "sd", KNOTS, levels, [i / 2 for i in range(13)], BLOCKS, "r7")


@query("block_length_sensitivity", "R8 Q20", "analysis:s block_days:i rho n:i ci_low ci_high", c.with_(c.NIGHTS, c.CALENDAR, """
    cal AS MATERIALIZED (SELECT k.year, k.night_date, k.day_index, n.* EXCLUDE (year, night_date), s.analysis, s.block_days FROM calendar k LEFT JOIN nights n USING (night_date),
      (VALUES ('length', 7, 0), ('length', 14, 0), ('length', 21, 0), ('length', 28, 0), ('single_1999', 14, 1999), ('single_2000', 14, 2000), ('single_2001', 14, 2001)) s(analysis, block_days, y)
      WHERE k.year >= 1999 AND (s.y = 0 OR s.y = k.year))""", c.block_draws("bd", "cal", BLOCKS, "r8", "block_days", "analysis, block_days"), """
    k AS (SELECT analysis, block_days, year, day_index, warmth, sd_tmin FROM cal WHERE regime = 'calm_clear' AND sd_tmin IS NOT NULL),
    e AS (SELECT analysis, block_days, replicate, warmth, sd_tmin FROM (SELECT k.*, replicate, unnest(range(times)) FROM bd JOIN k USING (analysis, block_days, year, day_index)))""",
       c.partial_sql("b", "e", "analysis, block_days, replicate", "warmth", "sd_tmin", (), 8), c.partial_sql("o", "k", "analysis, block_days", "warmth", "sd_tmin", (), 8)) + f"""
    SELECT analysis, block_days, o.rho, o.n, CASE WHEN nv >= {BLOCKS // 2} THEN ci_low END AS ci_low, CASE WHEN nv >= {BLOCKS // 2} THEN ci_high END AS ci_high
    FROM o JOIN (SELECT analysis, block_days, {CI.format(v='rho')}, count(rho) AS nv FROM b GROUP BY 1, 2) USING (analysis, block_days)""")
def block_length_sensitivity(t: Tables) -> DataFrame:
    from duskline.operators.association import spec_rows

    cal = panel.with_calendar(fixed_nights(t), m.calendar(t, m.HOLDOUT_YEARS), "night_date")
    cal = spec_rows(cal, [{"analysis": "length", "block_days": d} for d in (7, 14, 21, 28)] + [
        {"analysis": f"single_{y}", "block_days": 14, "where": F.col("year") == y} for y in m.HOLDOUT_YEARS])
    return rs.block_boot(cal, "warmth", "sd_tmin", F.col("regime") == "calm_clear", BLOCKS, "r8", F.col("block_days"), by=["analysis", "block_days"])


@query("stationary_bootstrap", "R9 Q11", "regime:s rho n:i ci_low ci_high", c.with_(c.NIGHTS, """
    q AS (SELECT regime, year, warmth, sd_tmin, row_number() OVER (PARTITION BY regime, year ORDER BY night_date) - 1 AS position,
                 count(*) OVER (PARTITION BY regime, year) AS n FROM nights WHERE sd_tmin IS NOT NULL),""" + f"""
    p AS (SELECT q.regime, q.year, q.n, position, replicate, position = 0 OR {c.draw('r9r', 'replicate', 'year', 'position')} / 268435456.0::DOUBLE < 1 / 14.0::DOUBLE AS fresh
          FROM q, (SELECT unnest(range({BLOCKS})) AS replicate)),
    f AS (SELECT *, max(CASE WHEN fresh THEN position END) OVER (PARTITION BY regime, year, replicate ORDER BY position) AS fr FROM p),
    s AS (SELECT regime, year, replicate, (({c.draw('r9s', 'replicate', 'year', 'fr')} % n) + position - fr) % n AS position FROM f),
    e AS (SELECT s.regime, replicate, warmth, sd_tmin FROM s JOIN q USING (regime, year, position))""",
       c.partial_sql("b", "e", "regime, replicate", "warmth", "sd_tmin"), c.partial_sql("o", "q", "regime", "warmth", "sd_tmin")) + f"""
    SELECT regime, o.rho, o.n, ci_low, ci_high FROM o JOIN (SELECT regime, {CI.format(v='rho')} FROM b GROUP BY 1) USING (regime)""")
def stationary_bootstrap(t: Tables) -> DataFrame:
    return rs.stationary_boot(fixed_nights(t), "warmth", "sd_tmin", "night_date", BLOCKS, "r9", ["regime"])


# --- effect sizes, anchors ----------------------------------------------------


@query("variance_decomposition", "T24 A18 Q8", "quantity:s rho n:i ci_low ci_high mean_var", c.with_(c.NIGHTS, """
    v AS (SELECT night_date, round(stddev_samp(t_even), 9) AS sd_even, round(stddev_samp(night_min), 9) AS sd_min, round(stddev_samp(t_even - night_min), 9) AS sd_total
          FROM sn WHERE t_even IS NOT NULL GROUP BY night_date),
    q AS (SELECT * FROM (SELECT unnest(['sd_even', 'sd_min', 'sd_total']) AS quantity, unnest([sd_even, sd_min, sd_total]) AS y, warmth AS x, year
          FROM v JOIN nights USING (night_date) WHERE regime = 'calm_clear') WHERE y IS NOT NULL)""", c.cluster_draws("d", "q", "year", CLUSTERS, "t24", "quantity")) + f""",
    e AS (SELECT quantity, replicate, x, y FROM (SELECT q.*, d.replicate, unnest(range(times)) AS t FROM q JOIN d USING (quantity, year))),
    r AS (SELECT quantity, replicate, x, {c.rank_avg('x', 'quantity, replicate')} rx, {c.rank_avg('y', 'quantity, replicate')} ry FROM e),
    b AS (SELECT quantity, replicate, corr(rx, ry) AS rho FROM r GROUP BY 1, 2),
    o AS (SELECT quantity, corr(a, b) AS rho, count(*) AS n, avg(y * y) AS mean_var FROM (SELECT quantity, y, {c.rank_avg('x', 'quantity')} a, {c.rank_avg('y', 'quantity')} b FROM q) GROUP BY 1)
    SELECT quantity, o.rho, n, ci_low, ci_high, mean_var FROM o JOIN (SELECT quantity, {CI.format(v='rho')} FROM b GROUP BY 1) USING (quantity)""")
def variance_decomposition(t: Tables) -> DataFrame:
    n = fixed_nights(t)
    v = ag.variance_identity(m.station_nights(t), "night_date", "t_even", "night_min")
    sd = v.select("night_date", *[F.round(F.sqrt(F.when(F.col(a) >= 0, F.col(a))), 9).alias(b) for a, b in
                                  (("var_a", "sd_even"), ("var_b", "sd_min"), ("var_diff", "sd_total"))])
    j = n.where("regime = 'calm_clear'").select("night_date", "year", "warmth").join(sd, "night_date")
    long = settled(j.unpivot(["year", "warmth"], ["sd_even", "sd_min", "sd_total"], "quantity", "y"))
    b = rs.cluster_boot_stat(long, "warmth", "y", "year", CLUSTERS, "t24", ["quantity"]).withColumnRenamed("estimate", "rho")
    return b.join(long.groupBy("quantity").agg(F.avg(F.col("y") * F.col("y")).alias("mean_var")), "quantity")


# Anchors of the cooling measures: hours of a mean against the night's minimum, or two hours four apart for a rate;
# clock hours, or hours since sunset. Half-open windows; an instant holds what is at most NEAR away.
NEAR = 0.13
TOTALS = {"total_20_22": ("clock", 20, 22), "total_19_21": ("clock", 19, 21), "total_21_23": ("clock", 21, 23), "total_sunset_0_2": ("since", 0, 2)}
RATES = {"rate_22_02": ("clock", 22, 26), "rate_21_01": ("clock", 21, 25), "rate_23_03": ("clock", 23, 27), "rate_sunset_1_5": ("since", 1, 5)}
_TOTAL_SQL = ", ".join(f"avg(value) FILTER ({h} >= {lo} AND {h} < {hi}) - min(value) AS {n}" for n, (h, lo, hi) in TOTALS.items())
_RATE_SQL = ", ".join(f"(avg(value) FILTER (abs({h} - {lo}) <= {NEAR}) - avg(value) FILTER (abs({h} - {hi}) <= {NEAR})) / 4.0 AS {n}" for n, (h, lo, hi) in RATES.items())
_NAMES = [*TOTALS, *RATES]


@query("anchor_sensitivity", "T25 P21 R4 Q8", "variant:s rho n:i ci_low ci_high", c.with_(c.NIGHTS, c.CALENDAR, SINCE, f"""
    a AS (SELECT station, night_date, {_TOTAL_SQL}, {_RATE_SQL} FROM (SELECT *, (hour(loc_ts) + 4) % 24 + 20 AS clock FROM ss) GROUP BY 1, 2),
    l AS (SELECT unnest([{', '.join(repr(n) for n in _NAMES)}]) AS variant, night_date, unnest([{', '.join(_NAMES)}]) AS q FROM a),
    p AS (SELECT variant, night_date, round(stddev_samp(q), 9) AS sd FROM l WHERE q IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
    k AS (SELECT variant, c.year, c.day_index, warmth, sd FROM p JOIN nights n USING (night_date) JOIN calendar c USING (night_date) WHERE regime = 'calm_clear')""",
       c.block_draws("bd", "calendar", BLOCKS, "t25"), "e AS (SELECT variant, replicate, warmth, sd FROM (SELECT k.*, replicate, unnest(range(times)) FROM bd JOIN k USING (year, day_index)))",
       c.partial_sql("b", "e", "variant, replicate", "warmth", "sd", (), 8), c.partial_sql("x", "k", "variant", "warmth", "sd", (), 8)) + f"""
    SELECT variant, x.rho, n, CASE WHEN nv >= {BLOCKS // 2} THEN ci_low END AS ci_low, CASE WHEN nv >= {BLOCKS // 2} THEN ci_high END AS ci_high
    FROM x JOIN (SELECT variant, {CI.format(v='rho')}, count(rho) AS nv FROM b GROUP BY 1) USING (variant)""")
def anchor_sensitivity(t: Tables) -> DataFrame:
    n = fixed_nights(t).where("regime = 'calm_clear'").select("night_date", "warmth")
    s = slots_since_sunset(t).withColumn("clock", (F.hour("loc_ts") + 4) % 24 + 20)
    mean = lambda ok: F.avg(F.when(ok, F.col("value")))
    at = lambda h, x: F.abs(F.col(h) - x) <= NEAR
    v = s.groupBy("station", "night_date").agg(
        *[(mean((F.col(h) >= lo) & (F.col(h) < hi)) - F.min("value")).alias(k) for k, (h, lo, hi) in TOTALS.items()],
        *[((mean(at(h, lo)) - mean(at(h, hi))) / 4.0).alias(k) for k, (h, lo, hi) in RATES.items()])
    long = v.unpivot(["station", "night_date"], _NAMES, "variant", "q").where(F.col("q").isNotNull())
    p = long.groupBy("variant", "night_date").agg(F.round(F.stddev_samp("q"), 9).alias("sd"), F.count("*").alias("k")).where("k >= 3")
    found = settled(p.join(n, "night_date"))
    cal = joins.factor_levels(m.calendar(t), variant=_NAMES).join(found.drop("k"), ["variant", "night_date"], "left")
    return rs.block_boot(cal, "warmth", "sd", F.col("sd").isNotNull(), BLOCKS, "t25", by=["variant"])


# --- lag scan, diurnal bias ---------------------------------------------------


def shifted_hours(t: Tables) -> DataFrame:
    """Network series on a 5-minute grid against an hourly reference, at 25 shifts."""
    r = m.readings(t).withColumn("net", F.lit("all"))
    mid = r.where("qc = 0").withColumn("ts", tp.midpoint("ts"))
    grid = series.interpolate(mid, "net", "ts", "value").where(F.col("value").isNotNull())
    sh = joins.factor_levels(grid, shift=list(range(-60, 61, 5)))
    # one label per (shift, reading): positive shifts move the network earlier
    sh = sh.withColumn("he", tp.ceil_hour(F.timestamp_add("MINUTE", -F.col("shift"), F.col("ts"))))
    hourly = sh.groupBy("shift", "he").agg(F.avg("value").alias("net_mean"), F.count("*").alias("n")).where("n >= 11")
    ref = r.where("qc = 1").groupBy(tp.ceil_hour("ts").alias("he")).agg(F.avg("value").alias("ref"), F.avg("rc").alias("rad"))
    return hourly.join(ref, "he").withColumn("hour", F.hour(tp.to_local(tp.shift_minutes("he", -30), m.TZ)))


SHIFTED = c.READINGS + """, o AS (SELECT ts, avg(value) AS v FROM (SELECT ts - INTERVAL 450 SECOND AS ts, value FROM readings WHERE qc = 0 AND value IS NOT NULL) GROUP BY 1),
    g AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 1435 MINUTE, INTERVAL 5 MINUTE)) AS ts FROM o),
    u AS (SELECT ts, v, EXISTS (SELECT 1 FROM g WHERE g.ts = x.ts) AS on_grid, count(v) OVER (ORDER BY ts) AS blk FROM (SELECT ts, o.v FROM o FULL JOIN g USING (ts)) x),
    w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS ta, last_value(v IGNORE NULLS) OVER b AS va,
                 first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS tb, first_value(v IGNORE NULLS) OVER f AS vb,
                 row_number() OVER (PARTITION BY blk ORDER BY ts) - 1 AS gap FROM u
          WINDOW b AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    gr AS (SELECT ts, CASE WHEN v IS NOT NULL THEN v WHEN ta IS NULL OR gap > 3 THEN NULL WHEN tb IS NULL THEN va
             ELSE va + (epoch_us(ts) - epoch_us(ta))::DOUBLE / (epoch_us(tb) - epoch_us(ta)) * (vb - va) END AS value FROM w WHERE on_grid),
    sh AS (SELECT shift, value, ts - shift * INTERVAL 1 MINUTE AS st FROM gr, (SELECT unnest(range(-60, 61, 5)) AS shift) WHERE value IS NOT NULL),
    hr AS (SELECT shift, CASE WHEN date_trunc('hour', st) = st THEN st ELSE date_trunc('hour', st) + INTERVAL 1 HOUR END AS he, avg(value) AS net_mean FROM sh GROUP BY 1, 2 HAVING count(*) >= 11),
    rf AS (SELECT CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS he, avg(value) AS ref, avg(rc) AS rad FROM readings WHERE qc = 1 GROUP BY 1),
    lg AS (SELECT shift, he, net_mean - ref AS e, rad, hour(timezone('Europe/Berlin', timezone('UTC', he - INTERVAL 30 MINUTE))) AS hour FROM hr JOIN rf USING (he))"""


@query("lag_scan", "T18 W12 Q23", "shift:i n:i rmse_all rmse_17_22 bias_17_22 rmse_night best:b", c.with_(SHIFTED) + """,
    a AS (SELECT shift, count(*) AS n, sqrt(avg(e * e)) AS rmse_all, sqrt(avg(e * e) FILTER (hour BETWEEN 17 AND 22)) AS rmse_17_22,
                 avg(e) FILTER (hour BETWEEN 17 AND 22) AS bias_17_22, sqrt(avg(e * e) FILTER (hour >= 22 OR hour <= 5)) AS rmse_night FROM lg GROUP BY shift)
    SELECT *, shift = (SELECT arg_min(shift, round(rmse_all, 9)) FROM a) AS best FROM a""")
def lag_scan(t: Tables) -> DataFrame:
    e = F.col("net_mean") - F.col("ref")
    eve, night = F.col("hour").between(17, 22), (F.col("hour") >= 22) | (F.col("hour") <= 5)
    a = settled(shifted_hours(t).groupBy("shift").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse_all"), F.sqrt(F.avg(F.when(eve, e * e))).alias("rmse_17_22"),
        F.avg(F.when(eve, e)).alias("bias_17_22"), F.sqrt(F.avg(F.when(night, e * e))).alias("rmse_night")))
    best = a.agg(F.min_by("shift", F.struct(F.round("rmse_all", 9), "shift"))).scalar()
    return a.withColumn("best", F.col("shift") == best)


@query("diurnal_bias", "T19 Q23", "hour:i mean_diff sd_diff n:i", c.with_(SHIFTED) + """
    SELECT hour, avg(e) AS mean_diff, stddev_samp(e) AS sd_diff, count(*) AS n FROM lg WHERE shift = 0 GROUP BY hour""")
def diurnal_bias(t: Tables) -> DataFrame:
    e = F.col("net_mean") - F.col("ref")
    return shifted_hours(t).where("shift = 0").groupBy("hour").agg(
        F.avg(e).alias("mean_diff"), F.stddev_samp(e).alias("sd_diff"), F.count("*").alias("n"))


@query("daily_bias_association", "T19", "rho n:i", c.with_(SHIFTED) + f""",
    d AS (SELECT CAST(he AS DATE) AS day, round(avg(rad) FILTER (hour BETWEEN 8 AND 18), 9) AS x, round(avg(e) FILTER (hour BETWEEN 18 AND 21), 9) AS y FROM lg WHERE shift = 0 GROUP BY 1),
    r AS (SELECT {c.rank_avg('x')} a, {c.rank_avg('y')} b FROM (SELECT * FROM d WHERE x IS NOT NULL AND y IS NOT NULL)) SELECT corr(a, b) AS rho, count(*) AS n FROM r""")
def daily_bias_association(t: Tables) -> DataFrame:
    from duskline.operators.association import spearman

    e = F.col("net_mean") - F.col("ref")
    d = shifted_hours(t).where("shift = 0").groupBy(F.to_date("he").alias("day")).agg(
        F.round(F.avg(F.when(F.col("hour").between(8, 18), F.col("rad"))), 9).alias("x"),
        F.round(F.avg(F.when(F.col("hour").between(18, 21), e)), 9).alias("y"))
    return spearman(d, "x", "y")


# --- censored times and relaxation --------------------------------------------

DELAY = DUSK + """, b AS (SELECT station, night_date, round_even(hss * 4, 0)::DOUBLE / 4 AS hbin, min(value) AS v FROM since WHERE hss BETWEEN 0 AND 9.5 GROUP BY 1, 2, 3),
    dl AS (SELECT station, night_date, coalesce(min(hbin) FILTER (v < 20), max(hbin)) AS delay, min(hbin) FILTER (v < 20) IS NULL AS censored
           FROM b GROUP BY 1, 2 HAVING count(*) >= 3),
    ct AS (SELECT station, delay, count(*) AS n_at, count(*) FILTER (NOT censored) AS ev FROM dl GROUP BY 1, 2),
    rk AS (SELECT *, sum(n_at) OVER (PARTITION BY station ORDER BY delay ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM ct),
    sv AS (SELECT *, CASE WHEN min(CASE WHEN ev = risk THEN 0 ELSE 1 END) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN ev < risk THEN ln(1 - ev::DOUBLE / risk) ELSE 0 END) OVER w) END AS s
           FROM rk WINDOW w AS (PARTITION BY station ORDER BY delay)),
    km AS (SELECT station, min(delay) FILTER (s <= 0.5 + 1e-12) AS km_median, sum(n_at) AS n, sum(ev) AS n_events FROM sv GROUP BY 1)"""


def cooling_delays(t: Tables, threshold: float = 20.0) -> DataFrame:
    s = since_sunset(t).where(F.col("hss").between(0.0, 9.5)).withColumn("hbin", tp.snap("hss"))
    b = s.groupBy("station", "night_date", "hbin").agg(F.min("value").alias("v"))
    return series.first_below(b, ["station", "night_date"], "hbin", "v", threshold, 3)


@query("kaplan_meier_median", "T20", "station:s km_median n:i n_events:i", c.with_(DELAY) + "SELECT * FROM km")
def kaplan_meier_median(t: Tables) -> DataFrame:
    return survival.km_median(cooling_delays(t), "station", "delay", "censored")


# Evenings count as hot from HOT degrees at sunset; a station-night needs BINS quarter hours, a station NIGHTS of them.
HOT, THRESHOLDS, LEAST_BINS, LEAST_NIGHTS = 45.0, (2.0, 5.0, 10.0), 3, 2
_HOT = f"""hb AS (SELECT station, night_date, round_even(hss * 4, 0)::DOUBLE / 4 AS hbin, min(value) AS v, avg(value) AS mean FROM since WHERE hss BETWEEN -0.375 AND 9.5 GROUP BY 1, 2, 3),
    hot AS (SELECT night_date FROM since WHERE round_even(hss * 4, 0) / 4 BETWEEN -0.25 AND 0.25 GROUP BY 1 HAVING avg(value) >= {HOT}),
    dl AS (SELECT threshold, station, night_date, coalesce(min(hbin) FILTER (v < threshold), max(hbin)) AS delay, min(hbin) FILTER (v < threshold) IS NULL AS censored
           FROM hb SEMI JOIN hot USING (night_date), (VALUES {', '.join(f'({x}::DOUBLE)' for x in THRESHOLDS)}) r(threshold) WHERE hbin >= 0 GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST_BINS}),
    st AS (SELECT threshold, station, quantile_cont(delay, 0.5) AS med, avg(censored::INT) AS cens, count(*) AS n FROM dl GROUP BY 1, 2 HAVING count(*) >= {LEAST_NIGHTS}),
    tr AS (SELECT 'S' || s_suppkey % 20 AS station, round(avg(s_acctbal), 9) AS trait FROM supplier GROUP BY 1),
    e AS (SELECT threshold, list_transform(quantile_cont(trait, [0.25, 0.5, 0.75]), lambda v: round(v, 9)) AS e FROM st JOIN tr USING (station) GROUP BY 1),
    q AS (SELECT st.*, trait, len(list_filter(e, lambda v: v < trait)) AS quartile FROM st JOIN tr USING (station) JOIN e USING (threshold)),
    ct AS (SELECT threshold, station, delay, count(*) AS n_at, count(*) FILTER (NOT censored) AS ev FROM dl GROUP BY 1, 2, 3),
    rk AS (SELECT *, sum(n_at) OVER (PARTITION BY threshold, station ORDER BY delay ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM ct),
    sv AS (SELECT *, CASE WHEN min(CASE WHEN ev = risk THEN 0 ELSE 1 END) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN ev < risk THEN ln(1 - ev::DOUBLE / risk) ELSE 0 END) OVER w) END AS s
           FROM rk WINDOW w AS (PARTITION BY threshold, station ORDER BY delay)),
    km AS (SELECT threshold, station, min(delay) FILTER (s <= 0.5 + 1e-12) AS km_median FROM sv GROUP BY 1, 2)"""


def hot_delays(t: Tables) -> DataFrame:
    """threshold, station, night_date, delay, censored on evenings that are hot at sunset."""
    s = since_sunset(t).withColumn("hbin", tp.snap("hss"))
    s = settled(s.where(F.col("hss").between(-0.375, 9.5)).select("station", "night_date", "hbin", "value"))
    hot = s.where(F.col("hbin").between(-0.25, 0.25)).groupBy("night_date").agg(F.avg("value").alias("v")).where(F.col("v") >= HOT).select("night_date")
    bins = s.where("hbin >= 0").join(hot, "night_date", "left_semi").groupBy("station", "night_date", "hbin").agg(F.min("value").alias("v"))
    firsts = [F.min(F.when(F.col("v") < x, F.col("hbin"))).alias(f"f{i}") for i, x in enumerate(THRESHOLDS)]
    each = bins.groupBy("station", "night_date").agg(F.max("hbin").alias("last"), F.count("*").alias("k"), *firsts).where(F.col("k") >= LEAST_BINS)
    rows = F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"f{i}").alias("first")) for i, x in enumerate(THRESHOLDS)])
    long = each.select("station", "night_date", "last", F.inline(rows))
    return long.select("threshold", "station", "night_date", F.coalesce("first", "last").alias("delay"), F.col("first").isNull().alias("censored"))


def station_trait(t: Tables) -> DataFrame:
    """An outside trait of every station."""
    return t.supplier.groupBy(F.concat(F.lit("S"), (F.col("s_suppkey") % 20).cast("string")).alias("station")).agg(F.round(F.avg("s_acctbal"), 9).alias("trait"))


@query("cooling_delay_report", "T21 W13 A21 Q23", "threshold n_station_nights:i n_stations:i km_undefined:i share_censored median_delay p10 p90 rho_trait low_quartile high_quartile km_low km_high",
       c.with_(DUSK, _HOT) + f""",
    d AS (SELECT dl.*, quartile FROM dl JOIN q USING (threshold, station)), j AS (SELECT q.*, km_median FROM q JOIN km USING (threshold, station)),
    r AS (SELECT threshold, corr(a, b) AS rho FROM (SELECT threshold, {c.rank_avg('trait', 'threshold')} a, {c.rank_avg('med', 'threshold')} b FROM q) GROUP BY 1)
    SELECT threshold, (SELECT count(*) FROM d WHERE d.threshold = j.threshold) AS n_station_nights, count(*) AS n_stations, count(*) - count(km_median) AS km_undefined,
           (SELECT avg(censored::INT) FROM d WHERE d.threshold = j.threshold) AS share_censored, (SELECT quantile_cont(delay, 0.5) FROM d WHERE d.threshold = j.threshold) AS median_delay,
           quantile_cont(med, 0.1) AS p10, quantile_cont(med, 0.9) AS p90, (SELECT rho FROM r WHERE r.threshold = j.threshold) AS rho_trait,
           quantile_cont(med, 0.5) FILTER (quartile = 0) AS low_quartile, quantile_cont(med, 0.5) FILTER (quartile = 3) AS high_quartile,
           CASE WHEN count(*) FILTER (quartile = 0 AND km_median IS NULL) = 0 THEN quantile_cont(km_median, 0.5) FILTER (quartile = 0) END AS km_low,
           CASE WHEN count(*) FILTER (quartile = 3 AND km_median IS NULL) = 0 THEN quantile_cont(km_median, 0.5) FILTER (quartile = 3) END AS km_high
    FROM j GROUP BY threshold""")
def cooling_delay_report(t: Tables) -> DataFrame:
    from duskline.operators.association import spearman

    d = settled(hot_delays(t))
    st = d.groupBy("threshold", "station").agg(F.percentile("delay", F.lit(0.5)).alias("med"), F.count("*").alias("n")).where(F.col("n") >= LEAST_NIGHTS)
    st = ranks.qcut(settled(st.join(station_trait(t), "station")), "trait", 4, ["threshold"], out="quartile")
    km = survival.km_median(d, ["threshold", "station"], "delay", "censored").select("threshold", "station", "km_median")
    st = settled(st.join(km, ["threshold", "station"]))
    mid = lambda col, q: F.percentile(F.when(F.col("quartile") == q, F.col(col)), F.lit(0.5))
    whole = lambda q: F.when(F.count_if((F.col("quartile") == q) & F.col("km_median").isNull()) == 0, mid("km_median", q))
    main = st.groupBy("threshold").agg(
        F.count("*").alias("n_stations"), F.count_if(F.col("km_median").isNull()).alias("km_undefined"), F.percentile("med", F.lit(0.1)).alias("p10"), F.percentile("med", F.lit(0.9)).alias("p90"),
        mid("med", 0).alias("low_quartile"), mid("med", 3).alias("high_quartile"), whole(0).alias("km_low"), whole(3).alias("km_high"))
    rows = d.join(st.select("threshold", "station"), ["threshold", "station"], "left_semi").groupBy("threshold").agg(
        F.count("*").alias("n_station_nights"), F.avg(F.col("censored").cast("double")).alias("share_censored"), F.percentile("delay", F.lit(0.5)).alias("median_delay"))
    rho = spearman(st, "trait", "med", ["threshold"]).select("threshold", F.col("rho").alias("rho_trait"))
    return main.join(rows, "threshold").join(rho, "threshold", "left")


def _relaxation_sql(src: str, levels: int = 5, points: int = 60) -> str:
    """CTEs ending in rx(night_date, t0, tau, fl, a, r2, n): least error over tau by grids that shrink around the best point. src: night_date, hbin, y."""
    out = [f"""rt AS MATERIALIZED (SELECT night_date, hbin - t0 AS t, y, t0, count(*) OVER (PARTITION BY night_date) AS n, var_pop(y) OVER (PARTITION BY night_date) AS vyy
        FROM (SELECT *, first_value(hbin) OVER (PARTITION BY night_date ORDER BY y DESC, hbin) AS t0 FROM {src}) WHERE hbin >= t0),
      rb0 AS (SELECT DISTINCT night_date, ln(0.3) AS lo, ln(30) AS hi FROM rt WHERE n >= 8)"""]
    for i in range(levels):
        out.append(f"""rg{i} AS (SELECT night_date, lo, hi, lo + (hi - lo) * k / {points}.0::DOUBLE AS lt FROM rb{i}, (SELECT unnest(range({points + 1})) AS k)),
      rs{i} AS MATERIALIZED (SELECT night_date, lt, any_value(lo) AS lo, any_value(hi) AS hi, any_value(t0) AS t0, any_value(n) AS n, any_value(vyy) AS vyy, avg(e) me, avg(y) my, avg(e * e) e2, avg(e * y) ey, avg(y * y) y2
        FROM (SELECT g.*, rt.t0, rt.n, rt.vyy, y, exp(-t / exp(lt)) AS e FROM rg{i} g JOIN rt USING (night_date)) GROUP BY 1, 2),
      rc{i} AS (SELECT *, my - coalesce((ey - me * my) / nullif(e2 - me * me, 0), 0) * me AS fl, coalesce((ey - me * my) / nullif(e2 - me * me, 0), 0) AS a FROM rs{i}
        UNION ALL SELECT *, 0, greatest(0, least(3, ey / e2)) FROM rs{i} UNION ALL SELECT *, 3, greatest(0, least(3, (ey - 3 * me) / e2)) FROM rs{i}
        UNION ALL SELECT *, greatest(0, least(3, my)), 0 FROM rs{i} UNION ALL SELECT *, greatest(0, least(3, my - 3 * me)), 3 FROM rs{i}),
      re{i} AS (SELECT *, n * (y2 + fl * fl + a * a * e2 - 2 * fl * my - 2 * a * ey + 2 * fl * a * me) AS sse FROM rc{i} WHERE fl BETWEEN 0 AND 3 AND a BETWEEN 0 AND 3),
      rp{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY night_date ORDER BY sse, lt) AS rn FROM re{i}) WHERE rn = 1),
      rb{i + 1} AS (SELECT night_date, greatest(ln(0.3), lt - (hi - lo) / {points}) AS lo, least(ln(30), lt + (hi - lo) / {points}) AS hi FROM rp{i})""")
    out.append(f"rx AS (SELECT night_date, t0, exp(lt) AS tau, fl, a, 1 - sse / nullif(n * vyy, 0) AS r2, n FROM rp{levels - 1})")
    return ", ".join(out)


_TAILS = "tails AS (SELECT night_date, hbin, sd / 100 AS y FROM prof WHERE hbin BETWEEN 0 AND 9 AND sd IS NOT NULL)"


def tails(t: Tables) -> DataFrame:
    return sunset_profile(t).where(F.col("hbin").between(0.0, 9.0) & F.col("sd").isNotNull()).withColumn("y", F.col("sd") / 100)


@query("relaxation_fits", "T22 Q11", "night_date:d peak_t tau:f3 floor:f3 amplitude:f3 fit_r2:f4 n_tail:i", c.with_(PROFILE, _TAILS, _relaxation_sql("tails")) + """
    SELECT night_date, t0 AS peak_t, tau, fl AS floor, a AS amplitude, r2 AS fit_r2, n AS n_tail FROM rx WHERE r2 > 0.3""")
def relaxation_fits(t: Tables) -> DataFrame:
    return rg.relaxation(tails(t), "night_date", "hbin", "y")


@query("relaxation_quality", "T22 Q11", "n_curves:i median_r2:f3", c.with_(PROFILE, _TAILS, _relaxation_sql("tails")) + """
    SELECT count(r2) AS n_curves, quantile_cont(r2, 0.5) AS median_r2 FROM rx""")
def relaxation_quality(t: Tables) -> DataFrame:
    return rg.relaxation(tails(t), "night_date", "hbin", "y", min_r2=float("-inf")).agg(F.count("fit_r2").alias("n_curves"), F.percentile("fit_r2", F.lit(0.5)).alias("median_r2"))


@query("dusk_variants", "A10 A12 J4 P6 Q15 S17", "night_date:d midpoint_all endpoint_all midpoint_no_rc endpoint_no_rc", c.with_(DUSK,
       "s0 AS (SELECT * FROM since WHERE rc = 0)",
       "d1 AS " + "(SELECT night_date, round(avg(sd), 9) AS v, 'midpoint_all' AS k FROM (SELECT night_date, hbin, stddev_samp(value) sd FROM (SELECT night_date, round_even(hss * 4, 0)::DOUBLE / 4 AS hbin, station, avg(value) AS value FROM since WHERE hss BETWEEN 0 AND 1 GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1 HAVING count(*) >= 2)",
       "d2 AS " + "(SELECT night_date, round(avg(sd), 9) AS v, 'endpoint_all' AS k FROM (SELECT night_date, hbin, stddev_samp(value) sd FROM (SELECT night_date, round_even(hss_end * 4, 0)::DOUBLE / 4 AS hbin, station, avg(value) AS value FROM since WHERE hss_end BETWEEN 0 AND 1 GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1 HAVING count(*) >= 2)",
       "d3 AS " + "(SELECT night_date, round(avg(sd), 9) AS v, 'midpoint_no_rc' AS k FROM (SELECT night_date, hbin, stddev_samp(value) sd FROM (SELECT night_date, round_even(hss * 4, 0)::DOUBLE / 4 AS hbin, station, avg(value) AS value FROM s0 WHERE hss BETWEEN 0 AND 1 GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1 HAVING count(*) >= 2)",
       "d4 AS " + "(SELECT night_date, round(avg(sd), 9) AS v, 'endpoint_no_rc' AS k FROM (SELECT night_date, hbin, stddev_samp(value) sd FROM (SELECT night_date, round_even(hss_end * 4, 0)::DOUBLE / 4 AS hbin, station, avg(value) AS value FROM s0 WHERE hss_end BETWEEN 0 AND 1 GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1 HAVING count(*) >= 2)") + """,
    un AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4)
    SELECT night_date, max(v) FILTER (k = 'midpoint_all') AS midpoint_all, max(v) FILTER (k = 'endpoint_all') AS endpoint_all,
           max(v) FILTER (k = 'midpoint_no_rc') AS midpoint_no_rc, max(v) FILTER (k = 'endpoint_no_rc') AS endpoint_no_rc FROM un GROUP BY night_date""")
def dusk_variants(t: Tables) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), h.alias("h"), ok.alias("ok")) for k, h, ok in (
        ("midpoint_all", F.col("hss"), F.lit(True)), ("endpoint_all", F.col("hss_end"), F.lit(True)),
        ("midpoint_no_rc", F.col("hss"), F.col("rc") == 0), ("endpoint_no_rc", F.col("hss_end"), F.col("rc") == 0))])
    s = since_sunset(t).where(F.col("hss").between(-0.5, 1.5)).select("station", "night_date", "value", "rc", F.inline(rows)).where("ok")
    d = panel.binned_dispersion(s, "h", 0.0, 1.0, 2, 2, by=["night_date", "variant"])
    return ag.pivot_fill(d, "night_date", "variant", ("midpoint_all", "endpoint_all", "midpoint_no_rc", "endpoint_no_rc"), F.max("dusk_sd"), fill=None)


# Fixed station sets by coverage of the nights; the dynamic set has no members of its own.
# A bin of a fixed set needs COMPLETE of its stations.
CORES, COMPLETE = (0.5, 0.8, 0.95), 0.1
_SET_SQL = f"""cov AS (SELECT station, count(DISTINCT night_date)::DOUBLE / (SELECT count(DISTINCT night_date) FROM since) AS coverage FROM since GROUP BY 1),
    sets AS (SELECT station, 'dynamic_all' AS station_set FROM cov UNION ALL SELECT station, 'fixed_core_' || CAST(round(100 * core) AS INT) FROM cov, (VALUES {', '.join(f'({x}::DOUBLE)' for x in CORES)}) r(core) WHERE coverage >= core),
    least AS (SELECT station_set, CASE WHEN station_set = 'dynamic_all' THEN 2 ELSE greatest(2, ceil({COMPLETE} * count(*))) END AS need FROM sets GROUP BY 1),
    rows AS (SELECT 'published' AS policy, 'midpoint' AS convention, station, night_date, hss AS h, value FROM since
      UNION ALL SELECT 'published', 'endpoint', station, night_date, hss_end, value FROM since UNION ALL SELECT 'corrected_excluded', 'midpoint', station, night_date, hss, value FROM since WHERE rc = 0),
    cell AS (SELECT station_set, policy, convention, night_date, round_even(h * 4, 0)::DOUBLE / 4 AS hbin, station, avg(value) AS value FROM rows JOIN sets USING (station)
      WHERE h BETWEEN 0 AND 1 AND (station_set = 'dynamic_all' OR (policy = 'published' AND convention = 'midpoint')) GROUP BY ALL),
    bins AS (SELECT station_set, policy, convention, night_date, hbin, stddev_samp(value) AS sd, count(*) AS n FROM cell GROUP BY ALL),
    dsk AS (SELECT station_set, policy, convention, night_date, round(avg(sd), 9) AS dusk_sd FROM bins JOIN least USING (station_set) WHERE n >= need GROUP BY ALL HAVING count(*) >= 2)"""


def dusk_by_station_set(t: Tables) -> DataFrame:
    """station_set, policy, convention, night_date, dusk_sd: the dusk metric of fixed and dynamic station sets from one pass over the evening readings."""
    s = settled(since_sunset(t).select("station", "night_date", "value", "rc", "hss", "hss_end"))
    total = s.select("night_date").distinct().agg(F.count("*")).scalar()
    cov = s.groupBy("station").agg((F.countDistinct("night_date") / total).alias("coverage"))
    named = F.array(F.lit("dynamic_all"), *[F.when(F.col("coverage") >= x, F.lit(f"fixed_core_{round(100 * x)}")) for x in CORES])
    sets = settled(cov.select("station", F.explode(F.filter(named, lambda v: v.isNotNull())).alias("station_set")))
    size = F.when(F.col("station_set") == "dynamic_all", 2).otherwise(F.greatest(F.lit(2), F.ceil(COMPLETE * F.count("*"))))
    least = sets.groupBy("station_set").agg(size.alias("need"))
    ways = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(k).alias("convention"), F.col(h).alias("h"), ok.alias("ok")) for p, k, h, ok in (
        ("published", "midpoint", "hss", F.lit(True)), ("published", "endpoint", "hss_end", F.lit(True)), ("corrected_excluded", "midpoint", "hss", F.col("rc") == 0))])
    rows = s.where(F.col("hss").between(-0.5, 1.5)).select("station", "night_date", "value", F.inline(ways)).where(F.col("ok") & F.col("h").between(0.0, 1.0))
    rows = rows.join(sets, "station").where((F.col("station_set") == "dynamic_all") | ((F.col("policy") == "published") & (F.col("convention") == "midpoint")))
    by = ["station_set", "policy", "convention", "night_date"]
    cell = rows.groupBy(*by, tp.snap("h").alias("hbin"), "station").agg(F.avg("value").alias("value"))
    bins = cell.groupBy(*by, "hbin").agg(F.stddev_samp("value").alias("sd"), F.count("*").alias("n")).join(least, "station_set").where("n >= need")
    return bins.groupBy(*by).agg(F.round(F.avg("sd"), 9).alias("dusk_sd"), F.count("*").alias("k")).where("k >= 2").drop("k")


@query("dusk_station_sets", "Q15 A10 J4", "station_set:s policy:s convention:s night_date:d dusk_sd", c.with_(DUSK, _SET_SQL) + "SELECT * FROM dsk")
def dusk_station_sets(t: Tables) -> DataFrame:
    return dusk_by_station_set(t)


@query("dusk_station_set_summary", "Q15 A8", "station_set:s policy:s convention:s n_nights:i mean_sd", c.with_(DUSK, _SET_SQL) + """
    SELECT station_set, policy, convention, count(*) AS n_nights, avg(dusk_sd) AS mean_sd FROM dsk GROUP BY ALL""")
def dusk_station_set_summary(t: Tables) -> DataFrame:
    return dusk_by_station_set(t).groupBy("station_set", "policy", "convention").agg(F.count("*").alias("n_nights"), F.avg("dusk_sd").alias("mean_sd"))


@query("correction_share_by_night_and_scope", "Q15 A3 A11", "scope:s value:s n_nights:i n_records:i n_flagged:i n_nights_flagged:i share", c.with_(DUSK) + """,
    nt AS (SELECT night_date, month(night_date) AS month, dayofweek(night_date) IN (0, 6) AS weekend, count(*) AS n, count(*) FILTER (rc = 1) AS k FROM since WHERE hss BETWEEN 0 AND 1 GROUP BY 1)
    SELECT scope, value, count(*) AS n_nights, sum(n) AS n_records, sum(k) AS n_flagged, count(*) FILTER (k > 0) AS n_nights_flagged, sum(k)::DOUBLE / sum(n) AS share FROM (
      SELECT *, unnest(['all', 'by_month', 'by_weekend', 'by_night']) AS scope, unnest(['all', CAST(month AS VARCHAR), CAST(weekend AS VARCHAR), CAST(night_date AS VARCHAR)]) AS value FROM nt) GROUP BY 1, 2""")
def correction_share_by_night_and_scope(t: Tables) -> DataFrame:
    s = since_sunset(t).where(F.col("hss").between(0.0, 1.0)).groupBy("night_date").agg(F.count("*").alias("n"), F.count_if(F.col("rc") == 1).alias("k"))
    weekend = F.dayofweek("night_date").isin(1, 7)
    scopes = F.array(*[F.struct(F.lit(a).alias("scope"), b.cast("string").alias("value")) for a, b in (
        ("all", F.lit("all")), ("by_month", F.month("night_date")), ("by_weekend", weekend), ("by_night", F.col("night_date")))])
    return s.select("n", "k", F.inline(scopes)).groupBy("scope", "value").agg(
        F.count("*").alias("n_nights"), F.sum("n").alias("n_records"), F.sum("k").alias("n_flagged"), F.count_if(F.col("k") > 0).alias("n_nights_flagged"), (F.sum("k") / F.sum("n")).alias("share"))
