"""From readings to panels: station-nights, city-nights, profiles, calendars.

All of these are filter + groupBy with map-side combining; a station, night or
source holding a third of the readings is folded before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.functions import timeparts as tp

# Ranks of panel values are compared across runs, so they are cut at this many
# decimals: summation order then cannot create or break a tie.
PANEL_DIGITS = 9


def qc_filter(df: DataFrame, value: str, qc: str, lo: float = -30.0, hi: float = 50.0) -> DataFrame:
    """Flag zero, value present and inside the plausible range."""
    return df.where((F.col(qc) == 0) & F.col(value).isNotNull() & F.col(value).between(lo, hi))


def with_night(df: DataFrame, ts: str, start: int, end: int, label_start: int | None = None) -> DataFrame:
    """Keep the night hours and add the evening date."""
    return df.where(tp.in_hours(ts, start, end)).withColumn(
        "night_date", tp.night_date(ts, start if label_start is None else label_start)
    )


def station_nights(
    df: DataFrame, start: int = 20, end: int = 8, months=(6, 7, 8), min_samples: int = 24,
    even_hours=(20, 21), late_hours=(22,), early_hours=(2,), exact: bool = False, gap_hours: float = 4.0,
    balance=None,
) -> DataFrame:
    """Night minimum, mean, maximum and cooling quantities per station and night.

    exact keeps only full-hour readings as anchors. balance = (hours, per_part)
    asks each [a, b) part of the night for at least per_part readings.
    """
    h = F.hour("loc_ts")
    on_hour = F.minute("loc_ts") == 0 if exact else F.lit(True)
    v = F.col("value")
    base = with_night(df, "loc_ts", start, end)
    if months:
        base = base.where(tp.in_season("night_date", months))
    aggs = [
        F.count("*").alias("n_samples"),
        F.round(F.min(v), PANEL_DIGITS).alias("night_min"),
        F.round(F.avg(v), PANEL_DIGITS).alias("night_mean"),
        F.round(F.max(v), PANEL_DIGITS).alias("night_max"),
        F.round(F.avg(F.when(h.isin(list(even_hours)), v)), PANEL_DIGITS).alias("t_even"),
        F.round(F.avg(F.when(h.isin(list(late_hours)) & on_hour, v)), PANEL_DIGITS).alias("t_late"),
        F.round(F.avg(F.when(h.isin(list(early_hours)) & on_hour, v)), PANEL_DIGITS).alias("t_early"),
    ]
    keep = F.col("n_samples") >= min_samples
    drop = []
    if balance is not None:
        parts, per_part = balance
        for i, (a, b) in enumerate(parts):
            aggs.append(F.count_if((h >= a) & (h < b)).alias(f"__part{i}"))
            keep = keep & (F.col(f"__part{i}") >= per_part)
            drop.append(f"__part{i}")
    return (
        base.groupBy("station", "night_date").agg(*aggs).where(keep).drop(*drop)
        .withColumns({
            "cool_rate": -(F.col("t_early") - F.col("t_late")) / F.lit(gap_hours),
            "cool_total": F.col("t_even") - F.col("night_min"),
            **tp.date_parts("night_date"),
        })
    )


def dispersion(col: str, digits: int = PANEL_DIGITS) -> dict[str, Column]:
    """Mean, median, SD, p90-p10, IQR and range of a column within a group.

    `percentile` keeps the group's distinct values: the group here is one
    night, bounded by the number of stations.
    """
    q = F.percentile(F.col(col), F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    r = lambda c: F.round(c, digits)
    at = lambda i: F.get(q, F.lit(i))
    return {
        "mean": r(F.avg(col)),
        "median": r(at(2)),
        "sd": r(F.stddev_samp(col)),
        "p90p10": r(at(4) - at(0)),
        "iqr": r(at(3) - at(1)),
        "range": r(F.max(col) - F.min(col)),
    }


def city_nights(sn: DataFrame, min_stations: int = 70, hot=(18.0, 20.0)) -> DataFrame:
    """Cross-station dispersion of every night with enough stations."""
    d, cr = dispersion("night_min"), dispersion("cool_rate")
    return (
        sn.groupBy("night_date")
        .agg(
            F.count("*").alias("n_stations"),
            d["mean"].alias("warmth"), d["median"].alias("median_tmin"), d["sd"].alias("sd_tmin"),
            d["p90p10"].alias("p90p10_tmin"), d["iqr"].alias("iqr_tmin"), d["range"].alias("range_tmin"),
            *[F.avg((F.col("night_min") >= h).cast("double")).alias(f"frac_ge{int(h)}") for h in hot],
            cr["mean"].alias("mean_cool_rate"), cr["sd"].alias("sd_cool_rate"), cr["p90p10"].alias("p90p10_cool_rate"),
            F.round(F.avg("cool_total"), PANEL_DIGITS).alias("mean_cool_total"),
            F.round(F.stddev_samp("cool_total"), PANEL_DIGITS).alias("sd_cool_total"),
            F.count("cool_rate").alias("n_cool_rate"),
        )
        .where(F.col("n_stations") >= min_stations)
    )


def areal_mean_total(df: DataFrame, unit: str, period, col: str, out: str) -> DataFrame:
    """Accumulations: sum within unit and period, then average over units."""
    period = [period] if isinstance(period, str) else list(period)
    per_unit = df.where(F.col(col).isNotNull()).groupBy(*period, unit).agg(F.sum(col).alias("__total"))
    return per_unit.groupBy(*period).agg(F.avg("__total").alias(out))


def profile(
    df: DataFrame, bin_col: str, min_units: int, value: str = "value", by=("night_date",), collapse: bool = False
) -> DataFrame:
    """Cross-station SD per night and bin; collapse first averages repeats of a station."""
    by = list(by)
    if collapse:
        df = df.groupBy(*by, bin_col, "station").agg(F.avg(value).alias(value))
    return (
        df.groupBy(*by, bin_col)
        .agg(F.round(F.stddev_samp(value), PANEL_DIGITS).alias("sd"), F.count("*").alias("n"),
             F.round(F.avg(value), PANEL_DIGITS).alias("mean"))
        .where(F.col("n") >= min_units)
    )


def binned_dispersion(
    df: DataFrame, hours: str, lo: float, hi: float, min_units: int, min_bins: int, by=("night_date",)
) -> DataFrame:
    """Station-bin mean, then bin SD with a station minimum, then night mean with a bin minimum.

    Window membership is tested on the unsnapped hours; bins are quarter hours.
    """
    by = list(by)
    cell = (
        df.where(F.col(hours).between(lo, hi))
        .withColumn("hbin", tp.snap(hours))
        .groupBy(*by, "hbin", "station")
        .agg(F.avg("value").alias("value"), F.max("rc").alias("rc"))
    )
    bins = (
        cell.groupBy(*by, "hbin")
        .agg(F.stddev_samp("value").alias("sd"), F.count("*").alias("n_units"), F.count_if(F.col("rc") == 1).alias("n_rc"))
        .where(F.col("n_units") >= min_units)
    )
    return (
        bins.groupBy(*by)
        .agg(
            F.round(F.avg("sd"), PANEL_DIGITS).alias("dusk_sd"),
            F.count("*").alias("n_bins"),
            F.avg("n_units").alias("mean_units"),
            F.min("n_units").alias("min_units"),
            (F.sum("n_rc") / F.sum("n_units")).alias("rc_fraction"),
        )
        .where(F.col("n_bins") >= min_bins)
    )


def calendar_spine(spark: SparkSession, years, start="06-01", end="08-31") -> DataFrame:
    """Every day of the season in every year, with its position inside the season."""
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year"))
    first = F.to_date(F.concat_ws("-", F.col("year").cast("string"), F.lit(start)))
    last = F.to_date(F.concat_ws("-", F.col("year").cast("string"), F.lit(end)))
    return rows.select("year", F.posexplode(F.sequence(first, last)).alias("day_index", "night_date"))


def with_calendar(df: DataFrame, spine: DataFrame, on) -> DataFrame:
    """Left join onto the spine: missing days stay, with NULLs."""
    on = [on] if isinstance(on, str) else list(on)
    return spine.join(df.drop(*[c for c in df.columns if c in spine.columns and c not in on]), on, "left")


def window_layers(df: DataFrame, windows: dict[str, tuple[int, int, int]], min_stations: int, months=(6, 7, 8)) -> DataFrame:
    """City-night dispersion for several night windows from one scan.

    windows maps a name to (start hour, end hour, minimum readings); a reading
    becomes one row per window it belongs to, and windows are told apart by id.
    """
    hits = [
        F.when(tp.in_hours("loc_ts", a, b), F.struct(F.lit(name).alias("win"), tp.night_date("loc_ts", a).alias("night_date"),
                                                     F.lit(n).alias("need")))
        for name, (a, b, n) in windows.items()
    ]
    rows = df.withColumn("__w", F.explode(F.array_compact(F.array(*hits)))).select("station", "value", "__w.*")
    sn = (
        rows.where(F.month("night_date").isin(list(months)))
        .groupBy("win", "station", "night_date")
        .agg(F.count("*").alias("n"), F.max("need").alias("need"), F.round(F.min("value"), PANEL_DIGITS).alias("night_min"))
        .where(F.col("n") >= F.col("need"))
    )
    d = dispersion("night_min")
    return (
        sn.groupBy("win", "night_date")
        .agg(F.count("*").alias("n_stations"), d["mean"].alias("warmth"), d["sd"].alias("sd_tmin"),
             d["p90p10"].alias("p90p10_tmin"), d["iqr"].alias("iqr_tmin"))
        .where(F.col("n_stations") >= min_stations)
    )
