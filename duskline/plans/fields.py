"""Spatial fields, panel effects and blocked validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.functions import timeparts as tp
from duskline.operators import association as at
from duskline.operators import fold_effects as fe
from duskline.operators import process, scalars, series
from duskline.operators import regression as rg
from duskline.operators import resample as rs
from duskline.operators import spatial as sp
from duskline.operators.joins import union_all
from duskline.operators.ranks import exact_quantiles
from duskline.plans import ctes as c
from duskline.plans.basics import DUSK, since_sunset
from duskline.plans.registry import query
from duskline.session import settled
from duskline.sources import mapping as m
from duskline.sources.tables import Tables

_PAIR = "round((s.x - g.cx) * (s.x - g.cx) + (s.y - g.cy) * (s.y - g.cy), 9)"


@query("nearest_station", "J9 X11", "cell_id:i nearest_station_id:i distance", c.with_(c.STATIONS, c.GRID) + f"""
    SELECT cell_id, arg_min(station_id, struct_pack(d := d2, i := station_id)) AS nearest_station_id, sqrt(min(d2)) AS distance
    FROM (SELECT cell_id, station_id, {_PAIR} AS d2 FROM grid g, stations s) GROUP BY 1""")
def nearest_station(t: Tables) -> DataFrame:
    return sp.nearest(m.grid_cells(t), m.stations(t), "cell_id", ("cx", "cy"), "station_id", ("x", "y"), per_tile=64)


@query("second_nearest_neighbour", "J10", "station_id:i neighbour_rank:i nearest_station_id:i distance", c.with_(c.STATIONS) + """
    SELECT station_id, rn AS neighbour_rank, other AS nearest_station_id, sqrt(d2) AS distance FROM (
      SELECT a.station_id, b.station_id AS other, d2, row_number() OVER (PARTITION BY a.station_id ORDER BY d2, b.station_id) AS rn
      FROM stations a, stations b, LATERAL (SELECT round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9) AS d2) WHERE a.station_id <> b.station_id) WHERE rn <= 2""")
def second_nearest_neighbour(t: Tables) -> DataFrame:
    s = m.stations(t)
    return sp.nearest(s, s, "station_id", ("x", "y"), "station_id", ("x", "y"), k=2, exclude_self=True, per_tile=64)


@query("match_within_distance", "J13", "cell_id:i nearest_station_id:i distance", c.with_(c.STATIONS, c.GRID) + f"""
    SELECT * FROM (SELECT cell_id, arg_min(station_id, struct_pack(d := d2, i := station_id)) AS nearest_station_id, sqrt(min(d2)) AS distance
    FROM (SELECT cell_id, station_id, {_PAIR} AS d2 FROM grid g, stations s) GROUP BY 1) WHERE distance <= 20""")
def match_within_distance(t: Tables) -> DataFrame:
    return sp.nearest(m.grid_cells(t), m.stations(t), "cell_id", ("cx", "cy"), "station_id", ("x", "y"), max_dist=20.0, per_tile=64)


@query("station_context", "X11 P23", "station_id:i nearest_cell_id:i distance field_a region:f", c.with_(c.STATIONS, c.GRID) + f"""
    SELECT station_id, nearest_cell_id, distance, CASE WHEN nearest_cell_id % 17 <> 0 THEN field_a END AS field_a, region FROM (
      SELECT station_id, arg_min(cell_id, struct_pack(d := d2, i := cell_id)) AS nearest_cell_id, sqrt(min(d2)) AS distance
      FROM (SELECT cell_id, station_id, {_PAIR} AS d2 FROM grid g, stations s) GROUP BY 1) JOIN grid ON cell_id = nearest_cell_id""")
def station_context(t: Tables) -> DataFrame:
    g = m.grid_cells(t).withColumn("field_a", F.when(F.col("cell_id") % 17 != 0, F.col("field_a")))
    n = sp.nearest(m.stations(t), g, "station_id", ("x", "y"), "cell_id", ("cx", "cy"), per_tile=64)
    return n.join(g.select(F.col("cell_id").alias("nearest_cell_id"), "field_a", "region"), "nearest_cell_id")


_IDW = f"""iw AS (SELECT cell_id, coalesce(min(target) FILTER (d <= 1e-9), sum(target * pow(greatest(1e-9, d), -2)) / sum(pow(greatest(1e-9, d), -2))) AS idw
    FROM (SELECT cell_id, target, sqrt((s.x - g.cx) * (s.x - g.cx) + (s.y - g.cy) * (s.y - g.cy)) AS d FROM grid g, stations s) GROUP BY 1)"""


def idw_field(t: Tables) -> DataFrame:
    return sp.idw(m.grid_cells(t), "cell_id", ("cx", "cy"), m.stations(t), "station_id", ("x", "y"), "target")


@query("inverse_distance_field", "X4 J11", "cell_id:i idw", c.with_(c.STATIONS, c.GRID, _IDW) + "SELECT * FROM iw")
def inverse_distance_field(t: Tables) -> DataFrame:
    return idw_field(t)


@query("inverse_distance_exact_hit", "X4", "station_id:i idw", c.with_(c.STATIONS) + "SELECT station_id, target AS idw FROM stations")
def inverse_distance_exact_hit(t: Tables) -> DataFrame:
    s = m.stations(t)
    return sp.idw(s, "station_id", ("x", "y"), s.withColumnRenamed("station_id", "sid"), "sid", ("x", "y"), "target")


@query("partition_signatures", "X10", "repeat:i signature:s n:i", c.with_(c.STATIONS) + """,
    p AS (SELECT r.repeat, station_id, (block + r.repeat) % 10 % (3 + r.repeat // 2) AS label FROM stations, (VALUES (0), (1), (2)) r(repeat)),
    q AS (SELECT *, min(station_id) OVER (PARTITION BY repeat, label) AS nm FROM p)
    SELECT repeat, sum(CAST('0x' || substr(md5(station_id || ':' || nm), 1, 12) AS BIGINT))::VARCHAR AS signature, count(*) AS n FROM q GROUP BY 1""")
def partition_signatures(t: Tables) -> DataFrame:
    r = m.stations(t).withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    label = (F.col("block") + F.col("repeat")) % 10 % (3 + F.floor(F.col("repeat") / 2))
    return sp.partition_signature(r.withColumn("label", label), "station_id", "label", ["repeat"])


def partitions(t: Tables) -> DataFrame:
    """Two spatial partitions: quantile blocks of the coordinates and of the rotated coordinates."""
    s = m.stations(t)
    a = sp.quantile_blocks(s, "x", "y", 3, 2).select(F.lit(0).alias("repeat"), "station_id", "block")
    rot = s.withColumns({"u": F.round(F.col("x") + F.col("y"), 6), "v": F.round(F.col("x") - F.col("y"), 6)})
    b = sp.quantile_blocks(rot, "u", "v", 3, 2).select(F.lit(1).alias("repeat"), "station_id", "block")
    return settled(union_all(a, b))


@query("quantile_blocks", "X7 R10", "repeat:i block:i n:i", c.with_(c.STATIONS) + """,
    r AS (SELECT station_id, 0 AS repeat, x AS u, y AS v FROM stations UNION ALL SELECT station_id, 1, round(x + y, 6), round(x - y, 6) FROM stations),
    e AS (SELECT repeat, round(quantile_cont(u, 1/3.0), 9) a, round(quantile_cont(u, 2/3.0), 9) b, round(quantile_cont(v, 0.5), 9) d FROM r GROUP BY 1)
    SELECT repeat, ((round(u, 9) > a)::INT + (round(u, 9) > b)::INT) * 2 + (round(v, 9) > d)::INT AS block, count(*) AS n FROM r JOIN e USING (repeat) GROUP BY 1, 2""")
def quantile_blocks(t: Tables) -> DataFrame:
    return partitions(t).groupBy("repeat", "block").agg(F.count("*").alias("n"))


REPEATS, BLOCKS, ROUNDS = 20, 6, 20


def _kmeans_sql(reps: int, src: str = "stations", key: str = "station_id", rounds: int = ROUNDS) -> str:
    """CTEs ending in km(repeat, key, block): Lloyd rounds of all repeats from counter-drawn starts."""
    far = "round((zx - cx) * (zx - cx) + (zy - cy) * (zy - cy), 9)"
    out = [f"""km_m AS MATERIALIZED (SELECT avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM {src}),
    km_p AS MATERIALIZED (SELECT {key}, round((x - mx) / sx, 12) AS zx, round((y - my) / sy, 12) AS zy FROM {src}, km_m),
    km_0 AS MATERIALIZED (SELECT repeat, pos - 1 AS block, zx AS cx, zy AS cy FROM (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY {c.draw('x10', 'repeat', key)}, {key}) AS pos
        FROM km_p, (SELECT unnest(range({reps})) AS repeat)) WHERE pos <= {BLOCKS})"""]
    for i in range(rounds + 1):
        out.append(f"km_a{i} AS MATERIALIZED (SELECT repeat, {key}, arg_min(block, struct_pack(d := {far}, b := block)) AS block, any_value(zx) AS zx, any_value(zy) AS zy FROM km_p, km_{i} GROUP BY 1, 2)")
        if i < rounds:
            out.append(f"""km_{i + 1} AS MATERIALIZED (SELECT repeat, block, coalesce(n.cx, o.cx) AS cx, coalesce(n.cy, o.cy) AS cy FROM km_{i} o
                LEFT JOIN (SELECT repeat, block, avg(zx) AS cx, avg(zy) AS cy FROM km_a{i} GROUP BY 1, 2) n USING (repeat, block))""")
    out.append(f"km AS (SELECT repeat, {key}, block FROM km_a{rounds})")
    return ", ".join(out)


def kmeans(t: Tables, repeats: int = REPEATS) -> DataFrame:
    """Repeated spatial K-means partitions of the stations."""
    return settled(sp.kmeans_partitions(m.stations(t), "station_id", "x", "y", repeats, BLOCKS, "x10", ROUNDS))


@query("kmeans_partition_signatures", "X7 X10", "repeat:i signature:s n:i", c.with_(c.STATIONS, _kmeans_sql(REPEATS)) + """,
    q AS (SELECT *, min(station_id) OVER (PARTITION BY repeat, block) AS nm FROM km)
    SELECT repeat, sum(CAST('0x' || substr(md5(station_id || ':' || nm), 1, 12) AS BIGINT))::VARCHAR AS signature, count(*) AS n FROM q GROUP BY 1""")
def kmeans_partition_signatures(t: Tables) -> DataFrame:
    return sp.partition_signature(kmeans(t), "station_id", "block", ["repeat"])


#: Rounds of alternating means in the SQL twins, enough for this panel to settle beyond the digits compared.
SETTLED = 40


def _fe_sql(rounds: int = SETTLED) -> str:
    out = [c.SLOTS, c.station_nights(), "u0 AS (SELECT DISTINCT station, 0.0::DOUBLE AS a FROM sn)"]
    for i in range(1, rounds + 1):
        out.append(f"t{i}r AS MATERIALIZED (SELECT night_date, avg(night_min - a) AS g FROM sn JOIN u{i - 1} USING (station) GROUP BY 1)")
        out.append(f"u{i}r AS MATERIALIZED (SELECT station, avg(night_min - g) AS a FROM sn JOIN t{i}r USING (night_date) GROUP BY 1)")
        out.append(f"h{i} AS (SELECT avg(a) AS s FROM u{i}r)")
        out.append(f"u{i} AS MATERIALIZED (SELECT station, a - s AS a FROM u{i}r, h{i})")
        out.append(f"t{i} AS MATERIALIZED (SELECT night_date, g + s AS g FROM t{i}r, h{i})")
    return c.with_(*out)


@query("two_way_effects", "X1", "station:s unit_effect n_nights:i", _fe_sql() + f"""
    SELECT station, a AS unit_effect, n AS n_nights FROM u{SETTLED} JOIN (SELECT station, count(*) AS n FROM sn GROUP BY 1) USING (station)""")
def two_way_effects(t: Tables) -> DataFrame:
    sn = settled(m.station_nights(t).select("station", "night_date", "night_min"))
    u, _ = sp.two_way_effects(sn, "station", "night_date", "night_min")
    return u.join(sn.groupBy("station").agg(F.count("*").alias("n_nights")), "station")


@query("coverage_adjusted_targets", "X1 X2 Q17", "station:s n_nights:i n_years:i raw_mean adjusted_mean target_se residual_rmse se_imputed:b", _fe_sql() + f""",
    o AS (SELECT sn.*, night_min - g AS o, a FROM sn JOIN t{SETTLED} USING (night_date) JOIN u{SETTLED} USING (station)),
    y AS (SELECT station, count(*) AS n_years, stddev_samp(m) / sqrt(count(*)) AS se FROM (SELECT station, year, avg(o) AS m FROM o GROUP BY 1, 2) GROUP BY 1)
    SELECT station, count(*) AS n_nights, max(n_years) AS n_years, avg(night_min) AS raw_mean, max(a) + (SELECT avg(g) FROM t{SETTLED}) AS adjusted_mean,
           coalesce(max(se), (SELECT quantile_cont(se, 0.5) FROM y)) AS target_se, sqrt(avg((o - a) ** 2)) AS residual_rmse, max(se) IS NULL AS se_imputed
    FROM o JOIN y USING (station) GROUP BY station""")
def coverage_adjusted_targets(t: Tables) -> DataFrame:
    sn = settled(m.station_nights(t).select("station", "night_date", "night_min", "year"))
    u, g = sp.two_way_effects(sn, "station", "night_date", "night_min")
    return sp.effect_targets(sn, u, g, "station", "night_date", "night_min", "year")


@query("converged_effects", "X1", "night_date:d time_effect", _fe_sql() + f"SELECT night_date, g AS time_effect FROM t{SETTLED}")
def converged_effects(t: Tables) -> DataFrame:
    sn = settled(m.station_nights(t).select("station", "night_date", "night_min"))
    return sp.two_way_effects(sn, "station", "night_date", "night_min")[1]


@query("panel_components", "X1", "component:s units:i", c.with_(c.SLOTS, c.station_nights()) + """
    SELECT (SELECT min(station) FROM sn) AS component, count(DISTINCT station) AS units FROM sn WHERE night_min IS NOT NULL""")
def panel_components(t: Tables) -> DataFrame:
    sn = settled(m.station_nights(t).where("night_min IS NOT NULL").select("station", "night_date").distinct())
    return sp.panel_components(sn, "station", "night_date").groupBy("component").agg(F.count("*").alias("units"))


@query("analysis_panel", "X3 J4 S14 S15", "station:s n:i mean_min", c.with_(c.NIGHTS) + """
    SELECT station, count(*) AS n, avg(night_min) AS mean_min FROM sn WHERE night_date IN (SELECT night_date FROM nights) AND night_min IS NOT NULL GROUP BY 1""")
def analysis_panel(t: Tables) -> DataFrame:
    from duskline.sources import checks

    sn, n = settled(m.station_nights(t)), m.nights(t).select("night_date")
    checks.assert_unique(sn, ["station", "night_date"])
    checks.require(checks.uncovered(sn, n, "night_date"), "nights without a station record")
    return sn.join(n, "night_date", "left_semi").where("night_min IS NOT NULL").groupBy("station").agg(
        F.count("*").alias("n"), F.avg("night_min").alias("mean_min"))


_TRAIT = DUSK + """, sb AS (SELECT station, night_date, round_even(hss * 4, 0)::DOUBLE / 4 AS hbin, value FROM since WHERE hss BETWEEN 0 AND 6),
    an AS (SELECT *, value - avg(value) OVER (PARTITION BY night_date, hbin) AS anom FROM sb)"""


def dusk_anomalies(t: Tables) -> DataFrame:
    s = since_sunset(t).where(F.col("hss").between(0.0, 6.0)).withColumn("hbin", tp.snap("hss"))
    return scalars.anomaly(s, ["night_date", "hbin"], "value", "anom")


@query("station_traits", "T27 W1 W10 W11 Q10", "station:s dusk_anom integral tail_slope", c.with_(_TRAIT) + """,
    p AS (SELECT station, hbin, avg(anom) AS a FROM an GROUP BY 1, 2),
    g AS (SELECT *, (hbin - lag(hbin) OVER w) * (a + lag(a) OVER w) / 2 AS seg FROM p WINDOW w AS (PARTITION BY station ORDER BY hbin))
    SELECT station, avg(a) FILTER (hbin BETWEEN 0 AND 1) AS dusk_anom, coalesce(sum(seg), 0) AS integral,
           CASE WHEN count(*) FILTER (hbin >= 1) >= 4 THEN regr_slope(a, hbin) FILTER (hbin >= 1) END AS tail_slope FROM g GROUP BY 1""")
def station_traits(t: Tables) -> DataFrame:
    p = dusk_anomalies(t).groupBy("station", "hbin").agg(F.avg("anom").alias("a"))
    dusk = p.groupBy("station").agg(F.avg(F.when(F.col("hbin").between(0.0, 1.0), F.col("a"))).alias("dusk_anom"))
    slope = series.tail_slope(p, "station", "hbin", "a", start=1.0).select("station", "tail_slope")
    return dusk.join(series.trapezoid(p, "station", "hbin", "a"), "station").join(slope, "station", "left")


@query("dusk_anomaly_targets", "X12 Q23", "station:s target sd n:i se", c.with_(_TRAIT) + """,
    p AS (SELECT station, night_date, avg(anom) AS a FROM an WHERE hbin <= 1 GROUP BY 1, 2)
    SELECT station, avg(a) AS target, stddev_samp(a) AS sd, count(*) AS n, stddev_samp(a) / sqrt(count(*)) AS se FROM p GROUP BY 1""")
def dusk_anomaly_targets(t: Tables) -> DataFrame:
    return sp.anomaly_targets(dusk_anomalies(t).where("hbin <= 1"), "station", "night_date", "anom")


# --- fields and their comparison ----------------------------------------------

CANDIDATES = process.candidates((20.0, 60.0, 180.0))


def gp_stations(t: Tables) -> DataFrame:
    return m.stations(t).withColumns({"se": F.lit(0.02), "region": F.col("block")})


@query("kernel_choice_by_region", "X5 X6", "region:i length signal noise lml:f4 signal_sd noise_sd range_010 range_005")
def kernel_choice_by_region(t: Tables) -> DataFrame:
    s = gp_stations(t)
    best = process.parameters(process.conditioned(s, "station_id", ("x", "y"), "target", "se", ["region"]), CANDIDATES, ["region"])
    sd = s.groupBy("region").agg(F.stddev_pop("target").alias("target_sd"))
    return process.kernel_summary(best.join(sd, "region"), F.col("target_sd"))


@query("process_field", "X5 Q17", "region:i cell_id:i gp_mean gp_sd")
def process_field(t: Tables) -> DataFrame:
    s = settled(gp_stations(t))
    best = settled(process.parameters(process.conditioned(s, "station_id", ("x", "y"), "target", "se", ["region"]), CANDIDATES, ["region"]))
    return process.field(m.grid_cells(t), "cell_id", ("cx", "cy"), s, "station_id", ("x", "y"), "target", "se", best, ["region"])


def supplier_stations(t: Tables) -> DataFrame:
    """Suppliers as stations of the multi-year panel, with plane coordinates."""
    return t.supplier.select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("station"),
                             F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 400.0).alias("y"))


def supplier_nights(t: Tables) -> DataFrame:
    """Summer minima of every supplier and night."""
    night = F.to_date("l_shipdate")
    raw = t.lineitem.select(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("station"), night.alias("night_date"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("v"))
    kept = raw.where(F.month("night_date").isin(list(m.SUMMER)) & F.col("v").between(-30.0, 50.0))
    return settled(kept.groupBy("station", "night_date").agg(F.min("v").alias("night_min")).withColumn("year", F.year("night_date")))


PLANE = process.candidates((400.0, 1000.0, 2500.0, 6000.0), (0.5, 1.0), (0.05, 0.3, 1.0))


def supplier_targets(t: Tables) -> DataFrame:
    """Coverage-adjusted mean of every supplier with the error of its annual means and its place."""
    sn = supplier_nights(t)
    whole = sn.select("station").distinct().withColumns({"repeat": F.lit(0), "block": F.lit(0)})
    out = fe.fold_targets(sn, whole, "station", "night_date", "night_min", "year", leave_out=[(0, -1)])  # nobody is left out
    middle = exact_quantiles(out, [], "se", [0.5]).agg(F.max("quantile")).scalar()
    out = out.select("station", F.col("target").alias("adjusted_mean"), F.coalesce("se", middle).alias("target_se"))
    return settled(out.join(supplier_stations(t), "station"))


def customer_cells(t: Tables) -> DataFrame:
    """Customers as grid cells of the suppliers' plane."""
    return t.customer.select(F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").alias("cx"), (F.col("c_nationkey") * 400.0 + 100.0).alias("cy"))


def adjusted_kernel(targets: DataFrame) -> DataFrame:
    return settled(process.parameters(process.conditioned(targets, "station", ("x", "y"), "adjusted_mean", "target_se"), PLANE))


@query("adjusted_target_kernel", "X5 X6 Q17", "length signal noise lml:f4 signal_sd noise_sd range_010 range_005")
def adjusted_target_kernel(t: Tables) -> DataFrame:
    s = supplier_targets(t)
    sd = s.agg(F.stddev_pop("adjusted_mean").alias("target_sd"))
    return process.kernel_summary(adjusted_kernel(s).join(F.broadcast(sd), how="left"), F.col("target_sd"))


@query("adjusted_target_field", "X5 X2 Q17", "cell_id:i gp_mean gp_sd")
def adjusted_target_field(t: Tables) -> DataFrame:
    s = supplier_targets(t)
    return process.field(customer_cells(t), "cell_id", ("cx", "cy"), s, "station", ("x", "y"), "adjusted_mean", "target_se", adjusted_kernel(s))


@query("kernel_support", "X6 A22 J9", "p quantile", """
    WITH s AS (SELECT s_suppkey AS k, s_acctbal AS x, s_nationkey * 400.0 AS y FROM supplier),
    d AS (SELECT c_custkey, sqrt(min(round((x - c_acctbal) * (x - c_acctbal) + (y - c_nationkey * 400.0 - 100.0) * (y - c_nationkey * 400.0 - 100.0), 9))) AS d FROM customer, s GROUP BY 1)
    SELECT unnest([0.05, 0.5, 0.95]) AS p, unnest(quantile_cont(d, [0.05, 0.5, 0.95])) AS quantile FROM d""")
def kernel_support(t: Tables) -> DataFrame:
    best = t.region.agg(F.lit(1.0).alias("length"))
    return process.support(customer_cells(t), "cell_id", ("cx", "cy"), supplier_stations(t), "station", ("x", "y"), best)


_WIDTHS = "repeat:i n:i r2 rmse mae rho coverage width coverage_target width_target"


@query("spatial_cross_validation", "X7 T30 Q17", _WIDTHS)
def spatial_cross_validation(t: Tables) -> DataFrame:
    cv = process.cross_validation(gp_stations(t).drop("block"), "station_id", ("x", "y"), "target", "se", kmeans(t), CANDIDATES)
    return rg.pred_metrics(settled(cv), "observed", "predicted", ["repeat"], "pred_sd", "target_se")


@query("spatial_validation_summary", "X7 T30 Q17", "metric:s p value")
def spatial_validation_summary(t: Tables) -> DataFrame:
    return rg.cv_summary(settled(spatial_cross_validation(t)), ["r2", "rmse", "mae", "rho", "coverage"])


TRAITS = ["elevation", "building", "canopy"]


@query("ridge_validation_summary", "X7 X8 T30 Q10", "metric:s p value")
def ridge_validation_summary(t: Tables) -> DataFrame:
    cv = sp.ridge_cv(m.stations(t).drop("block"), "station_id", "target", TRAITS, kmeans(t, 50))
    return rg.cv_summary(rg.pred_metrics(settled(cv), "observed", "predicted", ["repeat"]), ["r2", "rmse", "mae", "rho"])


@query("ridge_cross_validation", "X8 T30 Q10", "repeat:i n:i r2 rmse mae rho")
def ridge_cross_validation(t: Tables) -> DataFrame:
    cv = sp.ridge_cv(m.stations(t).drop("block"), "station_id", "target", TRAITS, kmeans(t, 50))
    return rg.pred_metrics(settled(cv), "observed", "predicted", ["repeat"])


@query("ridge_predictor_importance", "X8 Q10 Q23", "repeat:i dropped:s cv_r2 reduced_r2 delta_r2")
def ridge_predictor_importance(t: Tables) -> DataFrame:
    return sp.ridge_importance(m.stations(t).drop("block"), "station_id", "target", TRAITS, kmeans(t, 50))


@query("ridge_importance_summary", "X8 Q10 Q23", "dropped:s mean q05 q50 q95 n:i")
def ridge_importance_summary(t: Tables) -> DataFrame:
    return sp.quantile_summary(ridge_predictor_importance(t), "delta_r2", ["dropped"])


@query("ridge_coefficients", "X8 Q10 Q23", "predictor:s mean q05 q50 q95 n:i")
def ridge_coefficients(t: Tables) -> DataFrame:
    study = sp.ridge_study(m.stations(t).drop("block"), "station_id", "target", TRAITS, kmeans(t, 50))
    return sp.quantile_summary(study.coefficients, "coefficient", ["predictor"])


@query("fold_contained_validation", "X9 X1 Q24", _WIDTHS)
def fold_contained_validation(t: Tables) -> DataFrame:
    s, sn = settled(supplier_stations(t)), supplier_nights(t)
    folds = settled(sp.kmeans_partitions(s, "station", "x", "y", REPEATS, BLOCKS, "x9", ROUNDS))
    by = ["repeat", "fold"]
    every = fe.fold_targets(sn, folds, "station", "night_date", "night_min", "year")
    usual = every.groupBy(*by, "held").agg(F.avg("se").alias("__usual"))
    every = every.join(usual, [*by, "held"]).withColumn("se", F.coalesce("se", "__usual")).drop("__usual").join(s, "station")
    tgt, truth = settled(every.where("NOT held").drop("held")), settled(every.where("held").drop("held"))
    pred = process.fold_predictions(tgt, truth, "station", ("x", "y"), "target", "se", process.candidates((1000.0, 4000.0), (1.0,), (0.3, 1.0)), by)
    j = truth.select(*by, "station", F.col("target").alias("observed"), F.col("se").alias("target_se")).join(pred, [*by, "station"])
    return rg.pred_metrics(settled(j), "observed", "gp_mean", ["repeat"], "gp_sd", "target_se")


@query("prediction_metrics", "T30", "region:i n:i r2 rmse mae rho coverage width", c.with_(c.STATIONS, c.GRID, _IDW) + f""",
    p AS (SELECT region, field_a AS o, idw AS p, 0.2 AS sd FROM grid JOIN iw USING (cell_id)),
    r AS (SELECT region, corr(a, b) AS rho FROM (SELECT region, {c.rank_avg('o', 'region')} a, {c.rank_avg('p', 'region')} b FROM p) GROUP BY 1)
    SELECT region, count(*) AS n, 1 - avg((o - p) ** 2) / var_pop(o) AS r2, sqrt(avg((o - p) ** 2)) AS rmse, avg(abs(o - p)) AS mae, max(rho) AS rho,
           avg((abs(o - p) <= 1.96 * sd)::INT) AS coverage, avg(3.92 * sd) AS width FROM p JOIN r USING (region) GROUP BY 1""")
def prediction_metrics(t: Tables) -> DataFrame:
    j = settled(m.grid_cells(t).join(idw_field(t), "cell_id").withColumn("sd", F.lit(0.2)))
    return rg.pred_metrics(j, "field_a", "idw", ["region"], "sd")


@query("field_comparison", "T28 X13 T1", "scale:s pearson_r rmse mae bias n:i", c.with_(c.STATIONS, c.GRID, _IDW, """
    zz AS (SELECT idw, field_a, zx AS e, zy AS n, zx * zx AS ee, zy * zy AS nn, zx * zy AS en FROM (
      SELECT *, (cx - avg(cx) OVER ()) / stddev_pop(cx) OVER () AS zx, (cy - avg(cy) OVER ()) / stddev_pop(cy) OVER () AS zy FROM grid JOIN iw USING (cell_id)))""",
       c.linear_resid_sql("det", "zz", ["idw", "field_a"], ["e", "n", "ee", "nn", "en"])) + """
    SELECT 'raw' AS scale, corr(idw, field_a) AS pearson_r, sqrt(avg((idw - field_a) ** 2)) AS rmse, avg(abs(idw - field_a)) AS mae, avg(idw - field_a) AS bias, count(*) AS n FROM zz
    UNION ALL SELECT 'coordinate_detrended', corr(idw, field_a), NULL, NULL, NULL, count(*) FROM det""")
def field_comparison(t: Tables) -> DataFrame:
    j = settled(m.grid_cells(t).join(idw_field(t), "cell_id"))
    z = scalars.zscore(j, ["cx", "cy"], ddof=0)
    from duskline.functions.numeric import poly2

    z = z.withColumns(dict(zip(("e", "n", "ee", "nn", "en"), poly2("z_cx", "z_cy"))))
    res = rg.predict(rg.predict(z, "idw", ["e", "n", "ee", "nn", "en"], resid="ra"), "field_a", ["e", "n", "ee", "nn", "en"], fitted="f2", resid="rb")
    d = F.col("idw") - F.col("field_a")
    raw = j.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))
    st = raw.select(F.struct("rmse", "mae", "bias")).scalar()
    a = at.pearson(j, "idw", "field_a").select(F.lit("raw").alias("scale"), F.col("r").alias("pearson_r"), "n", *[st[k].alias(k) for k in ("rmse", "mae", "bias")])
    b = at.pearson(res, "ra", "rb").select(F.lit("coordinate_detrended").alias("scale"), F.col("r").alias("pearson_r"), "n")
    return union_all(a, b)


@query("field_comparison_raw", "T28 X13", "pearson_r rmse mae bias n:i", c.with_(c.STATIONS, c.GRID, _IDW) + """
    SELECT corr(idw, field_a) AS pearson_r, sqrt(avg((idw - field_a) ** 2)) AS rmse, avg(abs(idw - field_a)) AS mae, avg(idw - field_a) AS bias, count(*) AS n FROM grid JOIN iw USING (cell_id)""")
def field_comparison_raw(t: Tables) -> DataFrame:
    j = settled(m.grid_cells(t).join(idw_field(t), "cell_id"))
    d = F.col("idw") - F.col("field_a")
    return j.agg(F.corr("idw", "field_a").alias("pearson_r"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
                 F.avg(d).alias("bias"), F.count("*").alias("n"))


@query("field_at_stations", "X13 J13", "rho n:i", c.with_(c.STATIONS, c.GRID) + f""",
    nn AS (SELECT station_id, arg_min(cell_id, struct_pack(d := d2, i := cell_id)) AS cell_id, min(d2) AS d2 FROM (SELECT cell_id, station_id, {_PAIR} AS d2 FROM grid g, stations s) GROUP BY 1),
    v AS (SELECT target, field_a FROM nn JOIN grid USING (cell_id) JOIN stations USING (station_id) WHERE sqrt(d2) <= 20)
    SELECT corr(a, b) AS rho, count(*) AS n FROM (SELECT {c.rank_avg('target')} a, {c.rank_avg('field_a')} b FROM v)""")
def field_at_stations(t: Tables) -> DataFrame:
    s, g = m.stations(t), m.grid_cells(t)
    nn = sp.nearest(s, g, "station_id", ("x", "y"), "cell_id", ("cx", "cy"), max_dist=20.0, per_tile=64)
    j = nn.join(g.select(F.col("cell_id").alias("nearest_cell_id"), "field_a"), "nearest_cell_id").join(s.select("station_id", "target"), "station_id")
    return at.corr_matrix_any_size(settled(j), ["target", "field_a"]).select(F.col("r").alias("rho"), "n")


BLOCK_DRAWS = 2000
_SURFACE = ("e", "n", "ee", "nn", "en")


@query("spatial_block_bootstrap", "R10 Q11", "kind:s rho ci_low ci_high n_valid:i", c.with_(c.GRID, """
    e AS (SELECT round(quantile_cont(cx, 1/3.0), 9) a, round(quantile_cont(cx, 2/3.0), 9) b, round(quantile_cont(cy, 1/3.0), 9) d, round(quantile_cont(cy, 2/3.0), 9) f FROM grid),
    q AS (SELECT ((round(cx, 9) > a)::INT + (round(cx, 9) > b)::INT) * 3 + (round(cy, 9) > d)::INT + (round(cy, 9) > f)::INT AS block, field_a, field_b,
          zx AS e, zy AS n, zx * zx AS ee, zy * zy AS nn, zx * zy AS en
          FROM (SELECT *, (cx - avg(cx) OVER ()) / stddev_pop(cx) OVER () AS zx, (cy - avg(cy) OVER ()) / stddev_pop(cy) OVER () AS zy FROM grid), e)""",
       c.cluster_draws("d", "q", "block", BLOCK_DRAWS, "r10"), """
    w AS (SELECT replicate, block, times FROM d UNION ALL SELECT DISTINCT -1, block, 1 FROM q),
    x AS (SELECT replicate, field_a, field_b, e, n, ee, nn, en FROM (SELECT q.*, replicate, unnest(range(times)) AS t FROM q JOIN w USING (block)))""",
       c.partial_sql("raw", "x", "replicate", "field_a", "field_b"), c.partial_sql("det", "x", "replicate", "field_a", "field_b", _SURFACE, 3, raw=_SURFACE)) + """,
    l AS (SELECT 'raw' AS kind, replicate, rho FROM raw UNION ALL SELECT 'coordinate_detrended', replicate, rho FROM det)
    SELECT kind, max(rho) FILTER (replicate < 0) AS rho, quantile_cont(rho, 0.025) FILTER (replicate >= 0) AS ci_low, quantile_cont(rho, 0.975) FILTER (replicate >= 0) AS ci_high,
           count(rho) FILTER (replicate >= 0) AS n_valid FROM l GROUP BY kind""")
def spatial_block_bootstrap(t: Tables) -> DataFrame:
    from duskline.functions.numeric import poly2

    g = sp.quantile_blocks(m.grid_cells(t), "cx", "cy")
    z = scalars.zscore(g, ["cx", "cy"], ddof=0)
    z = z.withColumns(dict(zip(_SURFACE, poly2("z_cx", "z_cy"), strict=True)))
    r = settled(rs.block_rank_correlations(z, "field_a", "field_b", "block", BLOCK_DRAWS, "r10", _SURFACE))
    long = r.select("replicate", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(v).alias("v")) for k, v in (("raw", "rho"), ("coordinate_detrended", "partial"))])))
    ci = rs.interval(long.where("replicate >= 0"), "v", ["kind"])
    return ci.join(long.where("replicate < 0").select("kind", F.col("v").alias("rho")), "kind")


# --- reanalysis-style second source --------------------------------------------


@query("second_source_spread", "A24 S6 Q6", "night_date:d row_mean row_sd row_range", """
    WITH o AS (SELECT CAST(o_orderdate AS DATE) AS night_date, c_nationkey % 3 AS p, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
    n AS (SELECT night_date, avg(v) FILTER (p = 0) AS a, avg(v) FILTER (p = 1) AS b, avg(v) FILTER (p = 2) AS d FROM o GROUP BY 1),
    l AS (SELECT night_date, list_filter([a, b, d], lambda v: v IS NOT NULL) AS l FROM n)
    SELECT night_date, list_avg(l) AS row_mean, list_stddev_samp(l) AS row_sd, list_max(l) - list_min(l) AS row_range FROM l""")
def second_source_spread(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    p = F.col("c_nationkey") % 3
    n = o.groupBy(F.to_date("o_orderdate").alias("night_date")).agg(
        *[F.avg(F.when(p == i, F.col("o_totalprice"))).alias(f"p{i}") for i in range(3)])
    return n.select("night_date", *[e.alias(k) for k, e in scalars.row_stats(["p0", "p1", "p2"]).items()])


@query("second_source_association", "T2 Q6", "variable:s rho n:i", c.with_(c.NIGHTS) + f""",
    l AS (SELECT * FROM (SELECT unnest(['clearness', 'wind']) AS variable, day_rad AS x, unnest([clearness, wind]) AS y FROM nights) WHERE y IS NOT NULL)
    SELECT variable, corr(a, b) AS rho, count(*) AS n FROM (SELECT variable, {c.rank_avg('x', 'variable')} a, {c.rank_avg('y', 'variable')} b FROM l) GROUP BY 1""")
def second_source_association(t: Tables) -> DataFrame:
    long = m.nights(t).unpivot(["night_date", "day_rad"], ["clearness", "wind"], "variable", "y")
    return at.spearman(long, "day_rad", "y", ["variable"])


