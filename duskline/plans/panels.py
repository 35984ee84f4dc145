"""Panels: station-nights, city-nights, weather, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.functions import timeparts as tp
from duskline.operators import panel
from duskline.plans import ctes as c
from duskline.plans.registry import query
from duskline.sources import mapping as m
from duskline.sources.tables import Tables

EVENT_SN = """esn AS (
  SELECT station, night_date, count(*) AS n_samples, round(min(value), 9) AS night_min
  FROM (SELECT *, CASE WHEN hour(loc_ts) >= 20 THEN CAST(loc_ts AS DATE)
                       ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS night_date
        FROM clean WHERE hour(loc_ts) >= 20 OR hour(loc_ts) < 8)
  GROUP BY station, night_date HAVING count(*) >= 1)"""


@query(
    "city_night_dispersion", "Q1 S1 P1 P2 P3 P4 A1 A4 A6",
    "night_date:d n_stations:i warmth sd_tmin p90p10_tmin iqr_tmin range_tmin",
    c.with_(c.CLEAN, EVENT_SN) + """
    SELECT night_date, count(*) AS n_stations, round(avg(night_min), 9) AS warmth,
           round(stddev_samp(night_min), 9) AS sd_tmin,
           round(quantile_cont(night_min, 0.9) - quantile_cont(night_min, 0.1), 9) AS p90p10_tmin,
           round(quantile_cont(night_min, 0.75) - quantile_cont(night_min, 0.25), 9) AS iqr_tmin,
           round(max(night_min) - min(night_min), 9) AS range_tmin
    FROM esn GROUP BY night_date HAVING count(*) >= 3""",
)
def city_night_dispersion(t: Tables) -> DataFrame:
    sn = panel.station_nights(m.clean_local(t), months=None, min_samples=1)
    return panel.city_nights(sn, min_stations=3)


@query(
    "station_night_panel", "Q1 A1 A2 P14 D9",
    "station:s night_date:d n_samples:i night_min night_mean night_max t_even t_late t_early "
    "cool_rate cool_total year:i month:i",
    c.with_(c.SLOTS, c.station_nights()) + "SELECT * FROM sn",
)
def station_night_panel(t: Tables) -> DataFrame:
    return m.station_nights(t)


@query(
    "city_night_table", "Q1 A6 A7 A8 D10",
    "night_date:d n_stations:i warmth median_tmin sd_tmin p90p10_tmin iqr_tmin range_tmin frac_ge18 frac_ge20 "
    "mean_cool_rate sd_cool_rate p90p10_cool_rate mean_cool_total sd_cool_total n_cool_rate:i",
    c.with_(c.PANEL) + "SELECT * FROM city",
)
def city_night_table(t: Tables) -> DataFrame:
    return m.city_nights(t)


@query(
    "night_weather_regime", "Q2 D11 P15 P16 P18",
    "night_date:d day_rad clearness wind rh precip z_clearness z_wind calm_clear_index regime:s",
    c.with_(c.WEATHER) + "SELECT * FROM weather",
)
def night_weather_regime(t: Tables) -> DataFrame:
    return m.weather(t)


@query(
    "night_table", "J1 D10 D11",
    "night_date:d year:i warmth sd_tmin sd_cool_total day_rad clearness wind regime:s",
    c.with_(c.NIGHTS) + "SELECT * FROM nights",
)
def night_table(t: Tables) -> DataFrame:
    return m.nights(t)


@query(
    "calendar_spine_join", "J7 D12",
    "night_date:d year:i day_index:i n_stations:f warmth regime:s",
    c.with_(c.NIGHTS, c.CALENDAR) + """
    SELECT k.night_date, k.year, k.day_index, n.n_stations, n.warmth, n.regime
    FROM calendar k LEFT JOIN nights n USING (night_date)""",
)
def calendar_spine_join(t: Tables) -> DataFrame:
    return panel.with_calendar(m.nights(t), m.calendar(t), "night_date")
