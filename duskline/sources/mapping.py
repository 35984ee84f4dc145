"""Sensor-network views of the given tables.

`events` supplies timed readings of one month, `lineitem` a multi-year panel
(its line number is the hour of the night), `orders` the daily weather,
`embeddings` stations and grid cells, `part` with `lineitem` the screening
cells. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskline.functions import timeparts as tp
from duskline.operators import panel
from duskline.operators.scalars import label_by_quantiles, zscore_train
from duskline.sources.tables import Tables

TZ = "Europe/Berlin"
LAT, LON = 50.0, 10.0
SUMMER = (6, 7, 8)
DEV_YEARS = (1995, 1996, 1997, 1998)
HOLDOUT_YEARS = (1999, 2000, 2001)
YEARS = DEV_YEARS + HOLDOUT_YEARS
#: Moves halves of the sixth digit off the rounding boundary: far more than the last bits of a mean, far less than a digit.
TIES_UP = 3.1e-8


def readings(t: Tables) -> DataFrame:
    """Raw readings with ordinal qc and correction flags; ts is UTC."""
    return t.events.select(
        "event_id",
        F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("station"),
        "ts",
        "event_type",
        "value",
        (F.col("event_type") == "error").cast("int").alias("qc"),
        (F.get_json_object("props", "$.k").try_cast("long") % 4 == 0).cast("int").alias("rc"),
    )


def clean_local(t: Tables, hi: float = 300.0) -> DataFrame:
    """Valid readings with local wall-clock time."""
    return panel.qc_filter(readings(t), "value", "qc", -30.0, hi).withColumn("loc_ts", tp.to_local("ts", TZ))


def slots(t: Tables) -> DataFrame:
    """Hourly slots of a multi-year network, already in local time."""
    df = t.lineitem.select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("station"),
        F.timestamp_add("HOUR", F.col("l_linenumber") + 19, F.col("l_shipdate")).alias("loc_ts"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 100.0).alias("value"),
    )
    return df.where(F.col("value").between(-30.0, 50.0))


def station_nights(t: Tables, start: int = 20, end: int = 8, min_samples: int = 1) -> DataFrame:
    return panel.station_nights(
        slots(t), start, end, months=SUMMER, min_samples=min_samples, late_hours=(22, 23), early_hours=(1, 2)
    )


def city_nights(t: Tables, min_stations: int = 3, **window) -> DataFrame:
    return panel.city_nights(station_nights(t, **window), min_stations)


def daily_weather(t: Tables) -> DataFrame:
    """Daily covariates of the summer months."""
    return (
        t.orders.where(F.month("o_orderdate").isin(list(SUMMER)))
        .groupBy(F.to_date("o_orderdate").alias("night_date"))
        .agg(
            F.round(F.avg("o_totalprice") / 1000, 9).alias("day_rad"),
            F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / 1000, 9).alias("clearness"),
            F.count("*").cast("double").alias("wind"),
            F.avg((F.col("o_custkey") % 100).cast("double")).alias("rh"),
            F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("precip"),
        )
    )


def weather(t: Tables) -> DataFrame:
    """Weather with the calm-clear index and regime, both learnt on the development years."""
    train = F.year("night_date").isin(list(DEV_YEARS))
    z = zscore_train(daily_weather(t), ["clearness", "wind"], train)
    z = z.withColumn("calm_clear_index", F.round((F.col("z_clearness") - F.col("z_wind")) / 2, 9))
    return label_by_quantiles(
        z, "calm_clear_index", (1 / 3, 2 / 3), train, ("cloudy_windy", "mixed", "calm_clear"), "regime"
    )


def nights(t: Tables) -> DataFrame:
    """City-night dispersion with weather: one row per observed night."""
    return city_nights(t).join(weather(t), "night_date").withColumn("year", F.year("night_date"))


def calendar(t: Tables, years=YEARS) -> DataFrame:
    return panel.calendar_spine(t.spark, years)


def stations(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select(
        F.col("vec_id").alias("station_id"),
        (F.get(e, F.lit(0)).cast("double") * 1000).alias("x"),
        (F.get(e, F.lit(1)).cast("double") * 1000).alias("y"),
        F.get(e, F.lit(2)).cast("double").alias("target"),
        F.get(e, F.lit(7)).cast("double").alias("elevation"),
        F.get(e, F.lit(8)).cast("double").alias("building"),
        F.get(e, F.lit(9)).cast("double").alias("canopy"),
        F.col("label").cast("long").alias("block"),
    )


def grid_cells(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select(
        F.col("vec_id").alias("cell_id"),
        (F.get(e, F.lit(3)).cast("double") * 1000).alias("cx"),
        (F.get(e, F.lit(4)).cast("double") * 1000).alias("cy"),
        F.get(e, F.lit(5)).cast("double").alias("field_a"),
        F.get(e, F.lit(6)).cast("double").alias("field_b"),
        F.col("label").cast("long").alias("region"),
    )


def exact_mean(v: Column) -> Column:
    """Mean of doubles below 2^17 whose sum doesn't depend on the order: two parts of few binary digits, whose sums of up to 2^23 values are exact."""
    high = F.rint(v * F.lit(2.0**13)) / F.lit(2.0**13)
    low = F.rint((v - high) * F.lit(2.0**44)) / F.lit(2.0**44)
    return (F.sum(high) + F.sum(low)) / F.count(v)


def screen_cells(t: Tables, ties_up: bool = False) -> DataFrame:
    """One row per part: two heat layers with spread, three population layers, two urban-form layers.

    ties_up: heat that lies on a half of the sixth digit is rounded up whatever the order of its sum. A mean of 32 prices
    can lie there, and its last bit would then decide.
    """
    up = F.lit(TIES_UP if ties_up else 0.0)
    agg = t.lineitem.groupBy("l_partkey").agg(
        F.round(exact_mean(F.col("l_extendedprice")) + up, 6).alias("heat_gp"),
        F.round(exact_mean(F.col("l_extendedprice") / F.col("l_quantity")) + up, 6).alias("heat_idw"),
        F.round(F.coalesce(F.stddev_samp("l_extendedprice"), F.lit(0.0)), 6).alias("heat_sd"),
        F.sum("l_quantity").alias("residents"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("older"),
        F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.col("l_quantity"))
              .otherwise(0.0)).alias("older_lower"),
    )
    p = t.part.select(
        F.col("p_partkey").alias("cell_id"),
        F.col("p_size").cast("double").alias("canopy"),
        F.col("p_retailprice").alias("building"),
        (F.length("p_name").cast("double") * 10 + F.col("p_size")).alias("refuge_m"),
    )
    return p.join(agg, F.col("cell_id") == F.col("l_partkey")).drop("l_partkey")
