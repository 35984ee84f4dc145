"""Projections, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.functions import coords, numeric, solar
from duskline.functions import timeparts as tp
from duskline.operators import aggregates as ag
from duskline.operators import joins, panel, ranks, scalars, series
from duskline.plans import ctes as c
from duskline.plans.registry import query
from duskline.session import settled
from duskline.sources import mapping as m
from duskline.sources.tables import Tables

# --- projections and scalar functions ---------------------------------------


@query("quality_filter", "P1", "station:s n:i lo hi", c.with_(c.READINGS) + """
    SELECT station, count(*) AS n, min(value) AS lo, max(value) AS hi FROM readings
    WHERE qc = 0 AND value IS NOT NULL AND value BETWEEN -30 AND 50 GROUP BY station""")
def quality_filter(t: Tables) -> DataFrame:
    return panel.qc_filter(m.readings(t), "value", "qc").groupBy("station").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("local_wall_clock", "P2 P3 P4 P7",
       "event_id:i loc_ts:t night20:d night18:d night12:d in_night:b in_day:b year:i month:i doy:i hour_frac",
       """SELECT event_id, loc_ts,
         CASE WHEN hour(loc_ts) >= 20 THEN CAST(loc_ts AS DATE) ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS night20,
         CASE WHEN hour(loc_ts) >= 18 THEN CAST(loc_ts AS DATE) ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS night18,
         CASE WHEN hour(loc_ts) >= 12 THEN CAST(loc_ts AS DATE) ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS night12,
         hour(loc_ts) >= 20 OR hour(loc_ts) < 8 AS in_night, hour(loc_ts) >= 8 AND hour(loc_ts) < 20 AS in_day,
         year(loc_ts) AS year, month(loc_ts) AS month, dayofyear(loc_ts) AS doy,
         hour(loc_ts) + minute(loc_ts) / 60.0::DOUBLE AS hour_frac
       FROM (SELECT event_id, timezone('Europe/Berlin', timezone('UTC', ts)) AS loc_ts FROM events)""")
def local_wall_clock(t: Tables) -> DataFrame:
    df = t.events.select("event_id", tp.to_local("ts", m.TZ).alias("loc_ts"))
    return df.select("*", *[tp.night_date("loc_ts", h).alias(f"night{h}") for h in (20, 18, 12)],
                     tp.in_hours("loc_ts", 20, 8).alias("in_night"), tp.in_hours("loc_ts", 8, 20).alias("in_day"),
                     tp.fractional_hour("loc_ts").alias("hour_frac"),
                     *[e.alias(n) for n, e in tp.date_parts("loc_ts").items()])


@query("summer_label_filter", "P5", "year:i n:i", c.with_(c.SLOTS) + """
    SELECT year(d) AS year, count(*) AS n FROM (
      SELECT CASE WHEN hour(loc_ts) >= 20 THEN CAST(loc_ts AS DATE) ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS d FROM slots)
    WHERE month(d) IN (6, 7, 8) AND year(d) BETWEEN 1995 AND 1998 GROUP BY 1""")
def summer_label_filter(t: Tables) -> DataFrame:
    df = m.slots(t).withColumn("d", tp.night_date("loc_ts", 20)).where(tp.in_season("d", m.SUMMER, m.DEV_YEARS))
    return df.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"))


@query("interval_midpoints_and_bins", "P6 P8 P9 P10",
       "event_id:i mid:t hours_to_midnight hbin hour_end:t", """
    SELECT event_id, mid, hours_to_midnight, round_even(hours_to_midnight * 4, 0)::DOUBLE / 4 AS hbin,
           CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS hour_end
    FROM (SELECT event_id, ts, ts - INTERVAL 450 SECOND AS mid,
                 (epoch_us(ts - INTERVAL 450 SECOND) - epoch_us(date_trunc('day', ts))) / 3.6e9 AS hours_to_midnight FROM events)""")
def interval_midpoints_and_bins(t: Tables) -> DataFrame:
    df = t.events.select("event_id", "ts", tp.midpoint("ts").alias("mid"))
    h = tp.hours_since("mid", F.to_date("ts").cast("timestamp_ntz"))
    return df.select("event_id", "mid", h.alias("hours_to_midnight"), tp.snap(h).alias("hbin"), tp.ceil_hour("ts").alias("hour_end"))


SUN = """sun AS (
  SELECT d, (720 - 4 * ({lon} + s * degrees(acos(greatest(-1, least(1,
             cos(radians(90.833)) / (cos(radians({lat})) * cos(decl)) - tan(radians({lat})) * tan(decl)))))) - eq) / 60 AS h, s
  FROM (SELECT d, s,
      229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
      0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g)
        - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl
    FROM (SELECT d, s, 2 * pi() / 365 * (dayofyear(d) - 1) AS g FROM {days}, (VALUES (1), (-1)) v(s)))),
sunset AS (SELECT d AS night_date, h AS sunset_h,
             timezone('Europe/Berlin', timezone('UTC', d::TIMESTAMP + to_microseconds(CAST(round(h * 3.6e9) AS BIGINT)))) AS sunset_local
           FROM sun WHERE s = -1)"""


def sun_cte(days: str) -> str:
    return SUN.format(lat=m.LAT, lon=m.LON, days=days)


@query("sunset_times", "P11 P12", "night_date:d sunset_h:f5 night_hours:f5", """
    WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d0 FROM orders),
    alld AS (SELECT d0 AS d FROM days UNION SELECT d0 + 1 FROM days), """ + sun_cte("alld") + """
    SELECT d0 AS night_date, a.h AS sunset_h, 24 + b.h - a.h AS night_hours
    FROM days JOIN sun a ON a.d = d0 AND a.s = -1 JOIN sun b ON b.d = d0 + 1 AND b.s = 1""")
def sunset_times(t: Tables) -> DataFrame:
    d = t.orders.select(F.to_date("o_orderdate").alias("night_date")).distinct()
    return d.select("night_date", solar.sunset_utc_hours("night_date", m.LAT, m.LON).alias("sunset_h"),
                    solar.night_length_hours("night_date", m.LAT, m.LON).alias("night_hours"))


@query("radiation_and_cooling_terms", "P13 P14", "station:s night_date:d sigma_t4 rate total", c.with_(c.SLOTS, c.station_nights()) + """
    SELECT station, night_date, 5.670374419e-8 * pow(night_mean + 273.15, 4) AS sigma_t4,
           -(t_early - t_late) / 4.0 AS rate, t_even - night_min AS total FROM sn""")
def radiation_and_cooling_terms(t: Tables) -> DataFrame:
    return m.station_nights(t).select("station", "night_date", numeric.black_body("night_mean").alias("sigma_t4"),
                                      numeric.cooling_rate("t_late", "t_early").alias("rate"), F.col("cool_total").alias("total"))


@query("quantile_labels", "P15", "label:s n:i lo hi", c.with_(c.NIGHTS) + """,
    cut AS (SELECT round(quantile_cont(warmth, 0.2), 9) a, round(quantile_cont(warmth, 0.8), 9) b FROM nights WHERE year <= 1998)
    SELECT CASE WHEN warmth >= b THEN 'hot' WHEN warmth <= a THEN 'cool' ELSE 'middle' END AS label,
           count(*) AS n, min(warmth) AS lo, max(warmth) AS hi FROM nights, cut GROUP BY 1""")
def quantile_labels(t: Tables) -> DataFrame:
    n = m.nights(t)
    lab = scalars.label_by_quantiles(n, "warmth", (0.2, 0.8), F.col("year") <= 1998, ("cool", "middle", "hot"), "label")
    return lab.groupBy("label").agg(F.count("*").alias("n"), F.min("warmth").alias("lo"), F.max("warmth").alias("hi"))


@query("training_zscores", "P16", "night_date:d z_warmth z_day_rad", c.with_(c.NIGHTS) + """,
    s AS (SELECT avg(warmth) a, stddev_samp(warmth) b, avg(day_rad) c, stddev_samp(day_rad) d FROM nights WHERE year <= 1998)
    SELECT night_date, (warmth - a) / b AS z_warmth, (day_rad - c) / d AS z_day_rad FROM nights, s""")
def training_zscores(t: Tables) -> DataFrame:
    return scalars.zscore_train(m.nights(t), ["warmth", "day_rad"], F.col("year") <= 1998)


@query("zscores_by_degree_of_freedom", "P17 P18", "night_date:d z_warmth p_warmth y_warmth composite", c.with_(c.NIGHTS) + """,
    s AS (SELECT avg(warmth) a, stddev_samp(warmth) b, stddev_pop(warmth) p, avg(wind) w, stddev_samp(wind) ws FROM nights)
    SELECT night_date, (warmth - a) / b AS z_warmth, (warmth - a) / p AS p_warmth,
           (warmth - avg(warmth) OVER (PARTITION BY year)) / stddev_samp(warmth) OVER (PARTITION BY year) AS y_warmth,
           ((warmth - a) / b - (wind - w) / ws) / 2 AS composite FROM nights, s""")
def zscores_by_degree_of_freedom(t: Tables) -> DataFrame:
    n = m.nights(t)
    z = scalars.zscore(n, ["warmth", "wind"])
    z = scalars.zscore(z, ["warmth"], ddof=0, prefix="p_")
    z = scalars.zscore(z, ["warmth"], by="year", prefix="y_")
    return z.withColumn("composite", (F.col("z_warmth") - F.col("z_wind")) / 2)


@query("year_dummies_and_season", "P19 P20", "night_date:d season season_sq year_1996 year_1997 year_1998 year_1999 year_2000 year_2001",
       c.with_(c.NIGHTS) + """
    SELECT night_date, (dayofyear(night_date) - 196.5) / 30.0 AS season,
           ((dayofyear(night_date) - 196.5) / 30.0) * ((dayofyear(night_date) - 196.5) / 30.0) AS season_sq,
           (year = 1996)::INT AS year_1996, (year = 1997)::INT AS year_1997, (year = 1998)::INT AS year_1998,
           (year = 1999)::INT AS year_1999, (year = 2000)::INT AS year_2000, (year = 2001)::INT AS year_2001 FROM nights""")
def year_dummies_and_season(t: Tables) -> DataFrame:
    s, s2 = tp.season_terms(F.dayofyear("night_date"))
    return scalars.one_hot(m.nights(t).withColumns({"season": s, "season_sq": s2}), "year", m.YEARS)


@query("near_equal_anchor", "P21 P22", "station:s n:i mean_value", c.with_(c.CLEAN) + """
    SELECT station, count(*) AS n, avg(value) AS mean_value FROM clean
    WHERE value IS NOT NULL AND abs(hour(loc_ts) + minute(loc_ts) / 60.0::DOUBLE - 22.0) <= 0.13 + 1e-5 * 22 GROUP BY station""")
def near_equal_anchor(t: Tables) -> DataFrame:
    df = m.clean_local(t).na.drop(subset=["value"])
    return df.where(numeric.near(tp.fractional_hour("loc_ts"), 22.0)).groupBy("station").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query("null_flagged_keys", "P23", "l_partkey:i n:i n_price:i total", """
    SELECT l_partkey, count(*) AS n, count(CASE WHEN l_partkey % 17 <> 0 THEN l_extendedprice END) AS n_price,
           sum(CASE WHEN l_partkey % 17 <> 0 THEN l_extendedprice END) AS total FROM lineitem GROUP BY 1""")
def null_flagged_keys(t: Tables) -> DataFrame:
    flagged = t.part.where(F.col("p_partkey") % 17 == 0).select(F.col("p_partkey").alias("l_partkey"))
    li = t.lineitem.select("l_partkey", "l_extendedprice")
    return joins.null_where_key_in(li, "l_extendedprice", flagged, "l_partkey").groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.count("l_extendedprice").alias("n_price"), F.sum("l_extendedprice").alias("total"))


@query("coordinate_repair", "P24", "vec_id:i east_repaired:f3 north_repaired:f3 coordinate_source:s", """
    WITH r AS (SELECT vec_id, 47.0 + embedding[1]::DOUBLE AS lat, 8.5 + embedding[2]::DOUBLE AS lon,
                      2683000.0 + embedding[3]::DOUBLE * 400000 AS e, 1248000.0 + embedding[4]::DOUBLE * 400000 AS n FROM embeddings),
    s AS (SELECT *, (lat * 3600 - 169028.66) / 10000 AS p, (lon * 3600 - 26782.5) / 10000 AS l,
                 e BETWEEN 2650000 AND 2715000 AND n BETWEEN 1215000 AND 1280000 AS ok FROM r)
    SELECT vec_id,
      CASE WHEN ok THEN e ELSE 2600072.37 + 211455.93 * l - 10938.51 * l * p - 0.36 * l * p * p - 44.54 * l * l * l END AS east_repaired,
      CASE WHEN ok THEN n ELSE 1200147.07 + 308807.95 * p + 3745.25 * l * l + 76.63 * p * p - 194.56 * l * l * p
           + 119.79 * p * p * p END AS north_repaired,
      CASE WHEN ok THEN 'provided' ELSE 'wgs84_repair' END AS coordinate_source FROM s""")
def coordinate_repair(t: Tables) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    df = t.embeddings.select("vec_id", (at(0) + 47.0).alias("lat"), (at(1) + 8.5).alias("lon"),
                             (at(2) * 400000 + 2683000.0).alias("e"), (at(3) * 400000 + 1248000.0).alias("n"))
    return coords.repair_coords(df, "e", "n", "lat", "lon", (2650000, 2715000, 1215000, 1280000))


@query("clipped_shares", "P25", "cell_id:i share raw_share", c.with_(c.SCREEN) + """
    SELECT cell_id, greatest(0.1, least(0.5, older / residents)) AS share, older / residents AS raw_share FROM cells""")
def clipped_shares(t: Tables) -> DataFrame:
    raw = numeric.safe_div("older", "residents")
    return m.screen_cells(t).select("cell_id", numeric.clip(raw, 0.1, 0.5).alias("share"), raw.alias("raw_share"))


@query("text_columns", "P26", "p_partkey:i first_word:s n_words:i brand_no:i is_small:b has_ring:b spec:s size_class:s", """
    SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, len(string_split(p_name, ' ')) AS n_words,
           CAST(replace(replace(p_brand, 'Brand', ''), '#', '') AS BIGINT) AS brand_no,
           starts_with(p_name, 'small') AS is_small, contains(p_name, 'ring') AS has_ring,
           string_split(p_name || '__' || p_brand || '__' || p_type, '__')[3] AS spec,
           CASE p_type WHEN 'SMALL' THEN 's' WHEN 'LARGE' THEN 'l' END AS size_class FROM part""")
def text_columns(t: Tables) -> DataFrame:
    classes = F.create_map(F.lit("SMALL"), F.lit("s"), F.lit("LARGE"), F.lit("l"))
    words = F.split("p_name", " ")
    return t.part.select(
        "p_partkey", words[0].alias("first_word"), F.size(words).alias("n_words"),
        F.replace(F.replace("p_brand", F.lit("Brand"), F.lit("")), F.lit("#"), F.lit("")).cast("long").alias("brand_no"),
        F.startswith("p_name", F.lit("small")).alias("is_small"), F.contains("p_name", F.lit("ring")).alias("has_ring"),
        F.split(F.concat_ws("__", "p_name", "p_brand", "p_type"), "__")[2].alias("spec"),
        F.try_element_at(classes, "p_type").alias("size_class"))


@query("surface_terms_and_raster", "P29 P30", "cell_id:i e n ee nn en ix:i iy:i", c.with_(c.GRID) + """,
    s AS (SELECT avg(cx) mx, stddev_pop(cx) sx, avg(cy) my, stddev_pop(cy) sy, min(cx) x0, min(cy) y0 FROM grid)
    SELECT cell_id, (cx-mx)/sx AS e, (cy-my)/sy AS n, ((cx-mx)/sx)*((cx-mx)/sx) AS ee, ((cy-my)/sy)*((cy-my)/sy) AS nn,
           ((cx-mx)/sx)*((cy-my)/sy) AS en, CAST(round_even((cx-x0)/100, 0) AS BIGINT) AS ix,
           CAST(round_even((cy-y0)/100, 0) AS BIGINT) AS iy FROM grid, s""")
def surface_terms_and_raster(t: Tables) -> DataFrame:
    g = m.grid_cells(t)
    st = scalars.scalar_struct(g, x0=F.min("cx"), y0=F.min("cy"))
    z = scalars.zscore(g, ["cx", "cy"], ddof=0)
    terms = numeric.poly2("z_cx", "z_cy")
    return z.select("cell_id", *[e.alias(n) for n, e in zip(("e", "n", "ee", "nn", "en"), terms)],
                    numeric.raster_index("cx", st["x0"]).alias("ix"), numeric.raster_index("cy", st["y0"]).alias("iy"))


# --- joins -------------------------------------------------------------------


@query("left_and_full_joins", "J2 J3", "night_date:d left_hit:b n_stations:f f_rad", c.with_(c.PANEL, c.DAILY_WEATHER) + """
    SELECT night_date, w.wind IS NOT NULL AS left_hit, c.n_stations, w.day_rad AS f_rad
    FROM city c FULL JOIN daily_weather w USING (night_date)""")
def left_and_full_joins(t: Tables) -> DataFrame:
    w = m.daily_weather(t)
    return m.city_nights(t).join(w, "night_date", "full").select(
        "night_date", F.col("wind").isNotNull().alias("left_hit"), "n_stations", F.col("day_rad").alias("f_rad"))


@query("semi_and_anti_joins", "J4 J5 X3", "side:s n:i total", c.with_(c.NIGHTS) + """
    SELECT 'kept' AS side, count(*) AS n, sum(night_min) AS total FROM sn WHERE night_date IN (SELECT night_date FROM nights)
    UNION ALL SELECT 'dropped', count(*), sum(night_min) FROM sn WHERE night_date NOT IN (SELECT night_date FROM nights)""")
def semi_and_anti_joins(t: Tables) -> DataFrame:
    sn, keep = m.station_nights(t), m.nights(t).select("night_date")
    agg = lambda how, side: sn.join(keep, "night_date", how).agg(
        F.count("*").alias("n"), F.sum("night_min").alias("total")).select(F.lit(side).alias("side"), "n", "total")
    return joins.union_all(agg("left_semi", "kept"), agg("left_anti", "dropped"))


@query("factor_level_product", "J6", "win:s cut:f share:f regime:s n:i", c.with_(c.NIGHTS) + """
    SELECT w.v AS win, k.v AS cut, s.v AS share, regime, count(*) AS n
    FROM nights, (VALUES ('20-08'), ('21-07')) w(v), (VALUES (0.2), (0.25)) k(v), (VALUES (0.05), (0.1), (0.2)) s(v) GROUP BY ALL""")
def factor_level_product(t: Tables) -> DataFrame:
    x = joins.factor_levels(m.nights(t).select("regime"), win=("20-08", "21-07"), cut=(0.2, 0.25), share=(0.05, 0.1, 0.2))
    return x.groupBy("win", "cut", "share", "regime").agg(F.count("*").alias("n"))


@query("paired_stations", "J8 A19 Q14", "n:i bias median_diff sd_diff mae rmse q025 q975 min_diff max_diff share_within pearson_r",
       c.with_(c.SLOTS, c.station_nights()) + """,
    p AS (SELECT night_date, max(CASE WHEN station = 'S1' THEN night_min END) a, max(CASE WHEN station = 'S2' THEN night_min END) b
          FROM sn GROUP BY night_date)
    SELECT count(*) AS n, avg(a-b) AS bias, quantile_cont(a-b, 0.5) AS median_diff, stddev_samp(a-b) AS sd_diff,
           avg(abs(a-b)) AS mae, sqrt(avg((a-b)*(a-b))) AS rmse, quantile_cont(a-b, 0.025) AS q025,
           quantile_cont(a-b, 0.975) AS q975, min(a-b) AS min_diff, max(a-b) AS max_diff,
           avg(CASE WHEN abs(a-b) <= 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_within, corr(a, b) AS pearson_r
    FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_stations(t: Tables) -> DataFrame:
    p = joins.paired_series(m.station_nights(t), "station", "S1", "S2", "night_date", "night_min")
    return ag.paired_summary(p, "first", "second")


DUSK = c.CLEAN + """, evening AS (
  SELECT *, CASE WHEN hour(loc_ts) >= 12 THEN CAST(loc_ts AS DATE) ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS night_date
  FROM clean), edays AS (SELECT DISTINCT night_date AS d FROM evening), """ + sun_cte("edays") + """,
since AS (
  SELECT e.*, (epoch_us(loc_ts) - 450000000 - epoch_us(sunset_local)) / 3.6e9 AS hss,
         (epoch_us(loc_ts) - epoch_us(sunset_local)) / 3.6e9 AS hss_end
  FROM evening e JOIN sunset USING (night_date))"""


def sunsets(t: Tables) -> DataFrame:
    """Local sunset of every day the readings span, from the first to the last timestamp.

    One row per calendar day: the trigonometry never touches the readings, and
    the span is a min/max over a single column.
    """
    span = t.events.agg(F.date_sub(F.to_date(F.min("ts")), 1).alias("d0"), F.date_add(F.to_date(F.max("ts")), 1).alias("d1"))
    days = span.select(F.explode(F.sequence("d0", "d1")).alias("night_date"))
    return days.withColumn("sunset_local", tp.to_local(solar.sunset_utc("night_date", m.LAT, m.LON), m.TZ))


def since_sunset(t: Tables) -> DataFrame:
    """Valid readings with hours since sunset, by interval midpoint (hss) and by interval end (hss_end)."""
    r = m.clean_local(t).withColumn("night_date", tp.night_date("loc_ts", 12))
    s = r.join(sunsets(t), "night_date")
    return s.withColumns({"hss": tp.hours_since(tp.midpoint("loc_ts"), "sunset_local"),
                          "hss_end": tp.hours_since("loc_ts", "sunset_local")})


@query("readings_near_sunset", "J12 P8 P11", "event_id:i station:s night_date:d hss:f5", c.with_(DUSK) + """
    SELECT event_id, station, night_date, hss FROM since WHERE hss BETWEEN -1 AND 9.5""")
def readings_near_sunset(t: Tables) -> DataFrame:
    r = m.clean_local(t).withColumn("night_date", tp.night_date("loc_ts", 12))
    return joins.range_join(r, sunsets(t), "night_date", tp.hours_since(tp.midpoint("loc_ts"), "sunset_local"), -1.0, 9.5, "hss")


@query("matched_hours", "J14 P10 A19 Q19", "part:s n:i bias mae rmse q025 q975", c.with_(c.READINGS) + """,
    fine AS (SELECT CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS he,
                    avg(value) AS fine_mean, count(*) AS n FROM readings WHERE qc = 0 GROUP BY 1 HAVING count(*) = 12),
    coarse AS (SELECT CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS he,
                      avg(value) AS ref FROM readings WHERE qc = 1 GROUP BY 1),
    j AS (SELECT CASE WHEN hour(he) >= 20 OR hour(he) < 8 THEN 'night' ELSE 'day' END AS part, fine_mean - ref AS d FROM fine JOIN coarse USING (he))
    SELECT part, count(*) AS n, avg(d) AS bias, avg(abs(d)) AS mae, sqrt(avg(d*d)) AS rmse,
           quantile_cont(d, 0.025) AS q025, quantile_cont(d, 0.975) AS q975 FROM j GROUP BY part""")
def matched_hours(t: Tables) -> DataFrame:
    r = m.readings(t)
    ref = r.where("qc = 1").groupBy(tp.ceil_hour("ts").alias("he")).agg(F.avg("value").alias("ref"))
    j = joins.matched_hours(r.where("qc = 0"), "ts", "value", ref, "he", n=12)
    j = j.withColumn("part", F.when(tp.in_hours("he", 20, 8), "night").otherwise("day"))
    return ag.paired_summary(j, "fine_mean", "ref", ["part"])


@query("lagged_row_pairs", "J15", "lag:i n:i product_sum:f4", c.with_(c.NIGHTS) + """,
    r AS (SELECT warmth, row_number() OVER (ORDER BY night_date) AS p FROM nights)
    SELECT a.p - b.p AS lag, count(*) AS n, sum(a.warmth * b.warmth) AS product_sum
    FROM r a JOIN r b ON a.p - b.p BETWEEN 0 AND 7 GROUP BY 1""")
def lagged_row_pairs(t: Tables) -> DataFrame:
    pairs = joins.lag_pairs(m.nights(t).select("night_date", "warmth"), ["night_date"], ["warmth"], 7)
    return pairs.groupBy("lag").agg(F.count("*").alias("n"), F.sum(F.col("warmth") * F.col("warmth_lag")).alias("product_sum"))


@query("union_with_missing_columns", "J16 J17", "kind:s night_date:d warmth day_rad", c.with_(c.PANEL, c.DAILY_WEATHER) + """
    SELECT 'city' AS kind, night_date, warmth, NULL::DOUBLE AS day_rad FROM city
    UNION ALL SELECT 'weather', night_date, NULL, day_rad FROM daily_weather""")
def union_with_missing_columns(t: Tables) -> DataFrame:
    a = m.city_nights(t).select(F.lit("city").alias("kind"), "night_date", "warmth")
    return joins.union_all(a, m.daily_weather(t).select(F.lit("weather").alias("kind"), "night_date", "day_rad"))


@query("selection_overlap", "J18 J19", "regime:s n_a:i n_b:i n_both:i n_either:i jaccard", c.with_(c.NIGHTS) + """,
    f AS (SELECT regime, warmth >= 15 AS a, sd_tmin >= 10 AS b FROM nights)
    SELECT regime, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both,
           count(*) FILTER (a OR b) AS n_either,
           (count(*) FILTER (a AND b))::DOUBLE / nullif(count(*) FILTER (a OR b), 0) AS jaccard FROM f GROUP BY regime""")
def selection_overlap(t: Tables) -> DataFrame:
    return joins.jaccard(m.nights(t), F.col("warmth") >= 15, F.col("sd_tmin") >= 10, ["regime"])


@query("membership_categories", "J19 Q26", "category:s n:i", c.with_(c.NIGHTS) + """
    SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first_only' WHEN b THEN 'second_only' ELSE 'neither' END AS category, count(*) AS n
    FROM (SELECT coalesce(warmth >= 15, false) a, coalesce(sd_cool_total >= 5, false) b FROM nights) GROUP BY 1""")
def membership_categories(t: Tables) -> DataFrame:
    cat = joins.membership(F.col("warmth") >= 15, F.col("sd_cool_total") >= 5)
    return ag.value_counts(m.nights(t).withColumn("category", cat), "category")


# --- aggregates --------------------------------------------------------------


@query("quality_flag_audit", "A3 A5 Q12", "scope:s qc:i n:i n_value:i n_rc:i n_stations:i share", c.with_(c.READINGS) + """,
    l AS (SELECT *, timezone('Europe/Berlin', timezone('UTC', ts)) AS lt FROM readings),
    a AS (SELECT 'archive' AS scope, * FROM l UNION ALL SELECT 'study' AS scope, * FROM l WHERE day(lt) BETWEEN 5 AND 25)
    SELECT scope, qc, count(*) AS n, count(value) AS n_value, count(*) FILTER (rc = 1) AS n_rc, count(DISTINCT station) AS n_stations,
           count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY scope) AS share FROM a GROUP BY scope, qc""")
def quality_flag_audit(t: Tables) -> DataFrame:
    day = F.dayofmonth(tp.to_local("ts", m.TZ))
    scopes = F.array_compact(F.array(F.lit("archive"), F.when(day.between(5, 25), F.lit("study"))))
    df = m.readings(t).withColumn("scope", F.explode(scopes))
    g = df.groupBy("scope", "qc").agg(
        F.count("*").alias("n"), F.count("value").alias("n_value"), F.count_if(F.col("rc") == 1).alias("n_rc"),
        F.countDistinct("station").alias("n_stations"))
    tot = g.groupBy("scope").agg(F.sum("n").alias("__t"))
    return g.join(tot, "scope").withColumn("share", F.col("n") / F.col("__t").cast("double"))


@query("correction_share_by_hour", "A3 A7 Q12", "hour:i n:i n_rc:i share", c.with_(c.CLEAN) + """
    SELECT hour(loc_ts) AS hour, count(*) AS n, count(*) FILTER (rc = 1) AS n_rc, count(*) FILTER (rc = 1) / count(*)::DOUBLE AS share
    FROM clean GROUP BY 1""")
def correction_share_by_hour(t: Tables) -> DataFrame:
    return m.clean_local(t).groupBy(F.hour("loc_ts").alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(F.col("rc") == 1).alias("n_rc"), F.avg((F.col("rc") == 1).cast("double")).alias("share"))


@query("balanced_coverage_nights", "A4 Q18", "night_date:d n_stations:i warmth_balanced sd_balanced", c.with_(c.CLEAN) + """,
    b AS (SELECT station, night_date, round(min(value), 9) AS v FROM (
            SELECT station, value, hour(loc_ts) AS h, CASE WHEN hour(loc_ts) >= 20 THEN CAST(loc_ts AS DATE)
                   ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS night_date FROM clean WHERE hour(loc_ts) >= 20 OR hour(loc_ts) < 8)
          GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) FILTER (h >= 20) >= 1 AND count(*) FILTER (h < 4) >= 1
                          AND count(*) FILTER (h >= 4 AND h < 8) >= 1)
    SELECT night_date, count(*) AS n_stations, round(avg(v), 9) AS warmth_balanced, round(stddev_samp(v), 9) AS sd_balanced
    FROM b GROUP BY 1 HAVING count(*) >= 3""")
def balanced_coverage_nights(t: Tables) -> DataFrame:
    sn = panel.station_nights(m.clean_local(t), months=None, min_samples=5, balance=(((20, 24), (0, 4), (4, 8)), 1))
    return panel.city_nights(sn, 3).select("night_date", "n_stations", F.col("warmth").alias("warmth_balanced"),
                                           F.col("sd_tmin").alias("sd_balanced"))


@query("station_coverage", "A5 A8 A12 Q13",
       "station:s n_nights:i n_cool:i coverage mean_tmin y1995:i y1996:i y1997:i y1998:i y1999:i y2000:i y2001:i core80:b core95:b",
       c.with_(c.NIGHTS) + """,
    o AS (SELECT s.* FROM sn s WHERE night_date IN (SELECT night_date FROM nights))
    SELECT station, count(DISTINCT night_date) AS n_nights, count(cool_rate) AS n_cool,
           count(DISTINCT night_date)::DOUBLE / (SELECT count(*) FROM nights) AS coverage, avg(night_min) AS mean_tmin,
           count(DISTINCT night_date) FILTER (year = 1995) AS y1995, count(DISTINCT night_date) FILTER (year = 1996) AS y1996,
           count(DISTINCT night_date) FILTER (year = 1997) AS y1997, count(DISTINCT night_date) FILTER (year = 1998) AS y1998,
           count(DISTINCT night_date) FILTER (year = 1999) AS y1999, count(DISTINCT night_date) FILTER (year = 2000) AS y2000,
           count(DISTINCT night_date) FILTER (year = 2001) AS y2001,
           count(DISTINCT night_date)::DOUBLE / (SELECT count(*) FROM nights) >= 0.8 AS core80,
           count(DISTINCT night_date)::DOUBLE / (SELECT count(*) FROM nights) >= 0.95 AS core95
    FROM o GROUP BY station""")
def station_coverage(t: Tables) -> DataFrame:
    n = m.nights(t)
    o = m.station_nights(t).join(n.select("night_date"), "night_date", "left_semi")
    total = scalars.scalar_struct(n, n=F.count("*"))["n"].cast("double")
    main = o.groupBy("station").agg(F.countDistinct("night_date").alias("n_nights"), F.count("cool_rate").alias("n_cool"),
                                    F.avg("night_min").alias("mean_tmin"))
    years = ag.pivot_fill(o, "station", "year", m.YEARS, F.countDistinct("night_date"), "y")
    cov = F.col("n_nights") / total
    return main.join(years, "station").withColumns({"coverage": cov, "core80": cov >= 0.8, "core95": cov >= 0.95})


@query("areal_mean_totals", "A9", "night_date:d mean_total plain_total", """
    WITH o AS (SELECT CAST(o_orderdate AS DATE) AS night_date, c_nationkey % 3 AS station, o_totalprice AS v
               FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT night_date, avg(s) AS mean_total, sum(s) AS plain_total
    FROM (SELECT night_date, station, sum(v) AS s FROM o GROUP BY 1, 2) GROUP BY 1""")
def areal_mean_totals(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.to_date("o_orderdate").alias("night_date"), (F.col("c_nationkey") % 3).alias("station"), F.col("o_totalprice").alias("v"))
    plain = o.groupBy("night_date").agg(F.sum("v").alias("plain_total"))
    return panel.areal_mean_total(o, "station", "night_date", "v", "mean_total").join(plain, "night_date")


DUSK_SQL = """(SELECT night_date, round(avg(sd), 9) AS dusk_sd, count(*) AS n_bins, avg(n_units) AS mean_units, min(n_units) AS min_units,
                      sum(n_rc) / sum(n_units)::DOUBLE AS rc_fraction FROM (
      SELECT night_date, hbin, stddev_samp(value) AS sd, count(*) AS n_units, count(*) FILTER (rc = 1) AS n_rc FROM (
        SELECT night_date, round_even({h} * 4, 0)::DOUBLE / 4 AS hbin, station, avg(value) AS value, max(rc) AS rc
        FROM {src} WHERE {h} BETWEEN {lo} AND {hi} GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 2)
    GROUP BY night_date HAVING count(*) >= 3)"""


@query("dusk_dispersion", "A10", "night_date:d dusk_sd n_bins:i mean_units min_units:i rc_fraction",
       c.with_(DUSK) + "SELECT * FROM " + DUSK_SQL.format(h="hss", src="since", lo=0, hi=1))
def dusk_dispersion(t: Tables) -> DataFrame:
    return panel.binned_dispersion(since_sunset(t), "hss", 0.0, 1.0, 2, 3)


@query("scoped_summary", "A11", "scope:s level:s n:i mean_warmth sd_warmth", c.with_(c.NIGHTS) + """
    SELECT CASE WHEN grouping(year) = 0 THEN 'year' WHEN grouping(regime) = 0 THEN 'regime' ELSE 'all' END AS scope,
           coalesce(CAST(year AS VARCHAR), regime, 'all') AS level, count(*) AS n, avg(warmth) AS mean_warmth, stddev_samp(warmth) AS sd_warmth
    FROM nights GROUP BY GROUPING SETS ((), (year), (regime))""")
def scoped_summary(t: Tables) -> DataFrame:
    return ag.scoped(m.nights(t), ["year", "regime"], {
        "n": F.count("*"), "mean_warmth": F.avg("warmth"), "sd_warmth": F.stddev_samp("warmth")})


@query("regime_crosstab", "A13 A14 T31", "regime:s calm_clear:i mixed:i cloudy_windy:i n:i", c.with_(c.NIGHTS) + """,
    k AS (SELECT round(quantile_cont(day_rad, 1.0/3), 9) a, round(quantile_cont(day_rad, 2.0/3), 9) b FROM nights WHERE year <= 1998),
    l AS (SELECT regime, CASE WHEN day_rad >= b THEN 'calm_clear' WHEN day_rad <= a THEN 'cloudy_windy' ELSE 'mixed' END AS r2 FROM nights, k)
    SELECT regime, count(*) FILTER (r2 = 'calm_clear') AS calm_clear, count(*) FILTER (r2 = 'mixed') AS mixed,
           count(*) FILTER (r2 = 'cloudy_windy') AS cloudy_windy, count(*) AS n FROM l GROUP BY regime""")
def regime_crosstab(t: Tables) -> DataFrame:
    n = scalars.label_by_quantiles(m.nights(t), "day_rad", (1 / 3, 2 / 3), F.col("year") <= 1998,
                                   ("cloudy_windy", "mixed", "calm_clear"), "r2")
    wide = ag.pivot_fill(n, "regime", "r2", ("calm_clear", "mixed", "cloudy_windy"), F.count(F.lit(1)))
    return wide.join(ag.value_counts(n, "regime"), "regime")


@query("label_agreement", "T31", "n:i agreement spread_ratio", c.with_(c.NIGHTS) + """,
    k AS (SELECT round(quantile_cont(day_rad, 1.0/3), 9) a, round(quantile_cont(day_rad, 2.0/3), 9) b FROM nights WHERE year <= 1998),
    l AS (SELECT regime, sd_tmin, warmth, CASE WHEN day_rad >= b THEN 'calm_clear' WHEN day_rad <= a THEN 'cloudy_windy' ELSE 'mixed' END AS r2 FROM nights, k)
    SELECT count(*) AS n, avg(CASE WHEN regime = r2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS agreement,
           avg(sd_tmin) / stddev_samp(warmth) AS spread_ratio FROM l""")
def label_agreement(t: Tables) -> DataFrame:
    n = scalars.label_by_quantiles(m.nights(t), "day_rad", (1 / 3, 2 / 3), F.col("year") <= 1998,
                                   ("cloudy_windy", "mixed", "calm_clear"), "r2")
    return n.agg(F.count("*").alias("n"), F.avg((F.col("regime") == F.col("r2")).cast("double")).alias("agreement"),
                 numeric.safe_div(F.avg("sd_tmin"), F.stddev_samp("warmth")).alias("spread_ratio"))


@query("arg_max_bins", "A16 A17", "station:s best_date:d best_value first_date:d", c.with_(c.SLOTS, c.station_nights()) + """
    SELECT station, min(night_date) FILTER (night_min = mx) AS best_date, max(night_min) AS best_value, min(night_date) AS first_date
    FROM (SELECT *, max(night_min) OVER (PARTITION BY station) AS mx FROM sn) GROUP BY station""")
def arg_max_bins(t: Tables) -> DataFrame:
    sn = m.station_nights(t)
    best = ag.arg_row(sn, "station", "night_min", "night_date", ["night_date", "night_min"])
    first = sn.groupBy("station").agg(F.min_by("night_date", "night_date").alias("first_date"))
    return best.join(first, "station").select("station", F.col("night_date").alias("best_date"), F.col("night_min").alias("best_value"), "first_date")


@query("variance_identity", "A18", "night_date:d n:i var_a var_b var_diff cov_ab identity", c.with_(c.SLOTS, c.station_nights()) + """
    SELECT night_date, count(*) AS n, var_samp(t_even) AS var_a, var_samp(night_min) AS var_b, var_samp(t_even - night_min) AS var_diff,
           covar_samp(t_even, night_min) AS cov_ab, var_samp(t_even) + var_samp(night_min) - 2 * covar_samp(t_even, night_min) AS identity
    FROM sn WHERE t_even IS NOT NULL AND night_min IS NOT NULL GROUP BY night_date""")
def variance_identity(t: Tables) -> DataFrame:
    return ag.variance_identity(m.station_nights(t), "night_date", "t_even", "night_min")


@query("value_histogram", "A20", "bin:i lo hi n:i", c.with_(c.CLEAN) + """,
    e AS (SELECT unnest([0, 10, 25, 50, 100, 200, 300]) AS lo, unnest([10, 25, 50, 100, 200, 300, 300]) AS hi, unnest(range(7)) AS bin)
    SELECT bin, lo, hi, count(*) AS n FROM clean JOIN e ON bin < 6 AND value >= lo AND (value < hi OR (bin = 5 AND value <= hi)) GROUP BY ALL""")
def value_histogram(t: Tables) -> DataFrame:
    return ag.histogram(m.clean_local(t), "value", [0, 10, 25, 50, 100, 200, 300])


@query("equal_frequency_bins", "A21 T17", "bin:i n:i median_x median_y", c.with_(c.NIGHTS) + """,
    e AS (SELECT quantile_cont(day_rad, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM nights)
    SELECT bin, count(*) AS n, quantile_cont(day_rad, 0.5) AS median_x, quantile_cont(warmth, 0.5) AS median_y
    FROM (SELECT day_rad, warmth, len(list_filter(list_transform(e, lambda v: round(v, 9)), lambda v: v < round(day_rad, 9))) AS bin FROM nights, e)
    GROUP BY bin""")
def equal_frequency_bins(t: Tables) -> DataFrame:
    b = ranks.qcut(m.nights(t), "day_rad", 8)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.percentile("day_rad", F.lit(0.5)).alias("median_x"),
                                F.percentile("warmth", F.lit(0.5)).alias("median_y"))


@query("reading_percentiles", "A22", "station:s p quantile", c.with_(c.CLEAN) + """
    SELECT station, p, q AS quantile FROM (
      SELECT station, unnest([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS p,
             unnest(quantile_cont(value, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])) AS q FROM clean GROUP BY station)""")
def reading_percentiles(t: Tables) -> DataFrame:
    return ranks.exact_quantiles(m.clean_local(t), "station", "value", (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))


@query("row_statistics", "A24", "night_date:d row_mean row_sd row_max row_min row_range", c.with_(c.NIGHTS) + """
    SELECT night_date, list_avg(l) AS row_mean, list_stddev_samp(l) AS row_sd, list_max(l) AS row_max, list_min(l) AS row_min,
           list_max(l) - list_min(l) AS row_range
    FROM (SELECT night_date, list_filter([sd_tmin, iqr_tmin, sd_cool_total, mean_cool_rate], lambda v: v IS NOT NULL) AS l FROM nights)""")
def row_statistics(t: Tables) -> DataFrame:
    st = scalars.row_stats(["sd_tmin", "iqr_tmin", "sd_cool_total", "mean_cool_rate"])
    return m.nights(t).select("night_date", *[e.alias(n) for n, e in st.items()])


# --- windows -----------------------------------------------------------------


@query("night_anomalies", "W1", "station:s night_date:d anomaly", c.with_(c.SLOTS, c.station_nights()) + """
    SELECT station, night_date, night_min - avg(night_min) OVER (PARTITION BY night_date) AS anomaly FROM sn""")
def night_anomalies(t: Tables) -> DataFrame:
    return scalars.anomaly(m.station_nights(t), "night_date", "night_min")


@query("yearly_station_shift", "W2 Q13", "station:s year:i n_nights:i mean_anomaly change consecutive:b well_observed:b step_change:b",
       c.with_(c.SLOTS, c.station_nights()) + """,
    a AS (SELECT station, year, night_min - avg(night_min) OVER (PARTITION BY night_date) AS an FROM sn),
    y AS (SELECT station, year, count(*) AS n_nights, round(avg(an), 9) AS mean_anomaly FROM a GROUP BY 1, 2),
    g AS (SELECT *, lag(year) OVER w AS py, lag(n_nights) OVER w AS pn, mean_anomaly - lag(mean_anomaly) OVER w AS change FROM y
          WINDOW w AS (PARTITION BY station ORDER BY year))
    SELECT station, year, n_nights, mean_anomaly, change, coalesce(year - py = 1, false) AS consecutive,
           coalesce(year - py = 1 AND n_nights >= 30 AND pn >= 30, false) AS well_observed,
           coalesce(year - py = 1 AND n_nights >= 30 AND pn >= 30 AND abs(change) >= 0.5, false) AS step_change FROM g""")
def yearly_station_shift(t: Tables) -> DataFrame:
    a = scalars.anomaly(m.station_nights(t), "night_date", "night_min")
    y = a.groupBy("station", "year").agg(F.count("*").alias("n_nights"), F.round(F.avg("anomaly"), 9).alias("mean_anomaly"))
    out = series.yearly_shift(y, "station", "year", "mean_anomaly", "n_nights")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(False)) for k in ("well_observed", "step_change")})


PROFILE = DUSK + """, prof AS (
  SELECT night_date, hbin, round(stddev_samp(value), 9) AS sd, count(*) AS n, round(avg(value), 9) AS mean
  FROM (SELECT *, round_even(hss * 4, 0)::DOUBLE / 4 AS hbin FROM since WHERE hss BETWEEN -1 AND 9.5)
  GROUP BY 1, 2 HAVING count(*) >= 2)"""


def sunset_profile(t: Tables, min_units: int = 2) -> DataFrame:
    s = since_sunset(t).where(F.col("hss").between(-1.0, 9.5)).withColumn("hbin", tp.snap("hss"))
    return panel.profile(s, "hbin", min_units)


@query("cooling_rate_by_bin", "W3 A12", "night_date:d hbin mean rate", c.with_(PROFILE) + """
    SELECT night_date, hbin, mean, -(mean - lag(mean) OVER (PARTITION BY night_date ORDER BY hbin)) * 4 AS rate FROM prof""")
def cooling_rate_by_bin(t: Tables) -> DataFrame:
    return series.bin_rate(sunset_profile(t), "night_date", "hbin", "mean")


@query("average_ranks", "W4 W5 W6", "night_date:d r_warmth r_wind pct_wind rev_wind z_wind", c.with_(c.NIGHTS) + f"""
    SELECT night_date, {c.rank_avg('warmth', 'year')} AS r_warmth, {c.rank_avg('wind', 'year')} AS r_wind,
           {c.rank_avg('wind', 'year')} / count(*) OVER (PARTITION BY year) AS pct_wind,
           1 - {c.rank_avg('wind', 'year')} / count(*) OVER (PARTITION BY year) AS rev_wind,
           z AS z_wind
    FROM (SELECT *, (r - avg(r) OVER (PARTITION BY year)) / stddev_pop(r) OVER (PARTITION BY year) AS z FROM
          (SELECT *, {c.rank_avg('wind', 'year')} AS r FROM nights))""")
def average_ranks(t: Tables) -> DataFrame:
    n = ranks.with_ranks(m.nights(t), ["warmth", "wind"], "year")
    n = ranks.rank_z(n, ["wind"], "year")
    n = ranks.pct_rank(n, "wind", "year", "pct_wind")
    return ranks.pct_rank(n, "wind", "year", "rev_wind", reverse=True)


@query("reading_ranks", "W4 W5", "event_id:i rk pct", c.with_(c.CLEAN) + f"""
    SELECT event_id, {c.rank_avg('value')} AS rk, {c.rank_avg('value')} / count(*) OVER () AS pct FROM clean""")
def reading_ranks(t: Tables) -> DataFrame:
    r = ranks.spread_rank(m.clean_local(t), "value", (), "rk")
    return r.withColumn("pct", F.col("rk") / F.col("rk_n").cast("double"))


@query("top_share_of_cells", "W7", "cell_id:i canopy top05:b top20:b", c.with_(c.SCREEN) + """
    SELECT cell_id, canopy, row_number() OVER (ORDER BY canopy DESC, cell_id) <= ceil(0.05 * count(*) OVER ()) AS top05,
           row_number() OVER (ORDER BY canopy DESC, cell_id) <= ceil(0.2 * count(*) OVER ()) AS top20 FROM cells""")
def top_share_of_cells(t: Tables) -> DataFrame:
    f = ranks.top_shares(m.screen_cells(t), "canopy", (0.05, 0.20), "cell_id", out="top")
    return f.withColumns({"top05": F.get("top", F.lit(0)), "top20": F.get("top", F.lit(1))})


@query("score_tiers", "W8", "cell_id:i tier:s", c.with_(c.SCREEN) + """,
    q AS (SELECT round(quantile_cont(heat_gp, 0.5), 9) a, round(quantile_cont(heat_gp, 0.75), 9) b, round(quantile_cont(heat_gp, 0.9), 9) d FROM cells)
    SELECT cell_id, CASE WHEN heat_gp >= d THEN 'highest_priority' WHEN heat_gp >= b THEN 'high_priority'
                         WHEN heat_gp >= a THEN 'elevated_monitoring' ELSE 'baseline_monitoring' END AS tier FROM cells, q""")
def score_tiers(t: Tables) -> DataFrame:
    return ranks.tiers(m.screen_cells(t), "heat_gp")


@query("profile_scalars", "W9 W10 W11 W15 A16",
       "night_date:d n_bins:i complete:b integral tail_start n_tail:i tail_slope fixed_slope first_y last_y", c.with_(PROFILE) + """,
    s AS (SELECT * FROM prof WHERE hbin BETWEEN 0 AND 6),
    g AS (SELECT *, (hbin - lag(hbin) OVER w) * (sd + lag(sd) OVER w) / 2 AS seg,
                 first_value(hbin) OVER (PARTITION BY night_date ORDER BY sd DESC, hbin) AS pk FROM s WINDOW w AS (PARTITION BY night_date ORDER BY hbin))
    SELECT night_date, count(*) AS n_bins, count(*) = 25 AS complete, coalesce(sum(seg), 0) AS integral, min(pk) AS tail_start,
           count(*) FILTER (hbin >= pk) AS n_tail,
           CASE WHEN count(*) FILTER (hbin >= pk) >= 4 THEN regr_slope(sd, hbin) FILTER (hbin >= pk) END AS tail_slope,
           CASE WHEN count(*) FILTER (hbin >= 1) >= 4 THEN regr_slope(sd, hbin) FILTER (hbin >= 1) END AS fixed_slope,
           arg_min(sd, hbin) AS first_y, arg_max(sd, hbin) AS last_y
    FROM g GROUP BY night_date""")
def profile_scalars(t: Tables) -> DataFrame:
    p = settled(sunset_profile(t).where(F.col("hbin").between(0.0, 6.0)))
    out = series.complete(p, "night_date", "hbin", 0.0, 6.0)
    out = out.join(series.trapezoid(p, "night_date", "hbin", "sd"), "night_date")
    out = out.join(series.tail_slope(p, "night_date", "hbin", "sd"), "night_date")
    fixed = series.tail_slope(p, "night_date", "hbin", "sd", start=1.0, out="fixed_slope").select("night_date", "fixed_slope")
    return out.join(fixed, "night_date", "left").join(
        ag.edge_values(p, "night_date", "hbin", "sd").select("night_date", "first_y", "last_y"), "night_date")


@query("interpolated_grid", "W12", "station:s ts:t value", c.with_(c.READINGS) + """,
    o AS (SELECT station, ts, avg(value) AS v FROM readings WHERE qc = 0 AND value IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT station, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 1435 MINUTE, INTERVAL 5 MINUTE)) AS ts
          FROM o GROUP BY station),
    u AS (SELECT station, ts, o.v, g.ts IS NOT NULL AS on_grid FROM o FULL JOIN g USING (station, ts)),
    u2 AS (SELECT *, count(v) OVER (PARTITION BY station ORDER BY ts) AS blk FROM
           (SELECT u.station, u.ts, u.v, EXISTS (SELECT 1 FROM g WHERE g.station = u.station AND g.ts = u.ts) AS on_grid FROM u)),
    w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS ta, last_value(v IGNORE NULLS) OVER b AS va,
                 first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS tb, first_value(v IGNORE NULLS) OVER f AS vb,
                 row_number() OVER (PARTITION BY station, blk ORDER BY ts) - 1 AS gap FROM u2
          WINDOW b AS (PARTITION BY station ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 f AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT station, ts, CASE WHEN v IS NOT NULL THEN v WHEN ta IS NULL OR gap > 3 THEN NULL WHEN tb IS NULL THEN va
             ELSE va + (epoch_us(ts) - epoch_us(ta))::DOUBLE / (epoch_us(tb) - epoch_us(ta)) * (vb - va) END AS value
    FROM w WHERE on_grid""")
def interpolated_grid(t: Tables) -> DataFrame:
    return series.interpolate(m.readings(t).where("qc = 0"), "station", "ts", "value")


@query("first_bin_below", "W13", "station:s night_date:d first_below delay censored:b n_obs:i", c.with_(DUSK) + """,
    b AS (SELECT station, night_date, round_even(hss * 4, 0)::DOUBLE / 4 AS hbin, min(value) AS v FROM since WHERE hss BETWEEN 0 AND 9.5 GROUP BY 1, 2, 3)
    SELECT station, night_date, min(hbin) FILTER (v < 20) AS first_below, coalesce(min(hbin) FILTER (v < 20), max(hbin)) AS delay,
           min(hbin) FILTER (v < 20) IS NULL AS censored, count(*) AS n_obs FROM b GROUP BY 1, 2 HAVING count(*) >= 3""")
def first_bin_below(t: Tables) -> DataFrame:
    s = since_sunset(t).where(F.col("hss").between(0.0, 9.5)).withColumn("hbin", tp.snap("hss"))
    b = s.groupBy("station", "night_date", "hbin").agg(F.min("value").alias("v"))
    return series.first_below(b, ["station", "night_date"], "hbin", "v", 20.0, 3)


@query("sorted_positions", "W14", "year:i night_date:d position:i sd_tmin", c.with_(c.NIGHTS) + """
    SELECT year, night_date, row_number() OVER (PARTITION BY year ORDER BY sd_tmin, night_date) AS position, sd_tmin FROM nights""")
def sorted_positions(t: Tables) -> DataFrame:
    return series.ranked(m.nights(t), ["sd_tmin", "night_date"], "year")
