"""Swiss LV95 (EPSG:2056) coordinates from WGS84, published approximation formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskline.functions.timeparts import _col

# Coefficients of the published approximate WGS84 -> LV95 series
# (metres; latitude and longitude in 10,000 arc seconds from the origin).
ORIGIN_LAT_SEC, ORIGIN_LON_SEC = 169028.66, 26782.5
EAST = {"0": 2600072.37, "l": 211455.93, "lp": -10938.51, "lpp": -0.36, "lll": -44.54}
NORTH = {"0": 1200147.07, "p": 308807.95, "ll": 3745.25, "pp": 76.63, "llp": -194.56, "ppp": 119.79}


def wgs84_to_lv95(lat, lon) -> tuple[Column, Column]:
    p = (_col(lat) * F.lit(3600.0) - F.lit(ORIGIN_LAT_SEC)) / F.lit(10000.0)
    l = (_col(lon) * F.lit(3600.0) - F.lit(ORIGIN_LON_SEC)) / F.lit(10000.0)
    east = (F.lit(EAST["0"]) + F.lit(EAST["l"]) * l + F.lit(EAST["lp"]) * l * p
            + F.lit(EAST["lpp"]) * l * p * p + F.lit(EAST["lll"]) * l * l * l)
    north = (F.lit(NORTH["0"]) + F.lit(NORTH["p"]) * p + F.lit(NORTH["ll"]) * l * l
             + F.lit(NORTH["pp"]) * p * p + F.lit(NORTH["llp"]) * l * l * p + F.lit(NORTH["ppp"]) * p * p * p)
    return east, north


def repair_coords(df, east: str, north: str, lat: str, lon: str, bounds):
    """Keep coordinates inside bounds, rebuild the others from WGS84, and say which is which."""
    e0, e1, n0, n1 = bounds
    ok = F.coalesce(_col(east).between(e0, e1) & _col(north).between(n0, n1), F.lit(False))
    e_new, n_new = wgs84_to_lv95(lat, lon)
    return df.select(
        "*",
        F.when(ok, _col(east).cast("double")).otherwise(e_new).alias("east_repaired"),
        F.when(ok, _col(north).cast("double")).otherwise(n_new).alias("north_repaired"),
        F.when(ok, F.lit("provided")).otherwise(F.lit("wgs84_repair")).alias("coordinate_source"),
    )
