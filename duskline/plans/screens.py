"""Rank-based screens over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.functions import lanes
from duskline.operators import aggregates as ag
from duskline.operators import association as at
from duskline.operators import joins, ranks, uncertain
from duskline.operators import multiverse as mv
from duskline.operators import selection as sl
from duskline.plans import ctes as c
from duskline.plans.registry import query
from duskline.session import settled
from duskline.sources import mapping as m
from duskline.sources.tables import Tables

LAYERS = {"heat_gp": "heat_gp", "heat_idw": "heat_idw", "qmargin": "older", "lower": "older_lower", "all_residents": "residents",
          "cooling": "canopy", "intensity": "building"}
FIELDS = {"gp": "heat_gp", "idw": "heat_idw"}
LENSES = {"qmargin": "qmargin", "lower": "lower", "all_residents": "all_residents"}


def rank_cells(cells: DataFrame) -> DataFrame:
    return settled(sl.rank_layers(cells, "cell_id", LAYERS, reverse=("cooling",)))


def ranked_cells(t: Tables, ties_up: bool = True) -> DataFrame:
    """Percentile-rank components of every cell, computed once, from cells that are folded once: ranks and cells meet by value."""
    return rank_cells(settled(m.screen_cells(t, ties_up)))


_RK = ", rk AS MATERIALIZED (SELECT cell_id, " + ", ".join(
    ("1 - " if n == "cooling" else "") + f"{c.rank_avg(col)} / count(*) OVER () AS {n}" for n, col in LAYERS.items()) + " FROM cells)"
RANKED, RANKED_PLAIN = c.SCREEN_TIES_UP + _RK, c.SCREEN + _RK

W = sl.weight_scenarios()
_WSQL = ", ".join(f"('{n}', {', '.join(repr(v) + '::DOUBLE' for v in w)})" for n, w in W.items())
_DEC = f""", dec AS MATERIALIZED (
  SELECT cell_id, f.heat_field, w.weight_scenario, l.population_lens,
         round(100.0 * (CASE f.heat_field WHEN 'gp' THEN heat_gp ELSE heat_idw END * w0
               + CASE l.population_lens WHEN 'qmargin' THEN qmargin WHEN 'lower' THEN "lower" ELSE all_residents END * w1 + cooling * w2 + intensity * w3), 9) AS score
  FROM rk, (VALUES ('gp'), ('idw')) f(heat_field), (VALUES ('qmargin'), ('lower'), ('all_residents')) l(population_lens),
       (VALUES {_WSQL}) w(weight_scenario, w0, w1, w2, w3)),
sel AS MATERIALIZED (
  SELECT *, max(CASE WHEN heat_field = 'gp' AND weight_scenario = 'baseline' AND population_lens = 'qmargin' THEN selected END) OVER (PARTITION BY cell_id, share) AS baseline
  FROM (SELECT dec.*, share, row_number() OVER (PARTITION BY heat_field, weight_scenario, population_lens, share ORDER BY score DESC, cell_id)
               <= ceil(round(share * count(*) OVER (PARTITION BY heat_field, weight_scenario, population_lens, share), 9)) AS selected
        FROM dec, (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.15::DOUBLE), (0.20::DOUBLE)) s(share)))"""
SCORED, SCORED_PLAIN = RANKED + _DEC, RANKED_PLAIN + _DEC


def decisions(t: Tables, ties_up: bool = True) -> DataFrame:
    return sl.decisions(ranked_cells(t, ties_up), "cell_id", FIELDS, LENSES)


def selections(t: Tables, keep=()) -> mv.Multiverse:
    """Every cell's scores and the cuts of every decision; `keep`: columns of the cells that stay beside them."""
    cells = settled(m.screen_cells(t, ties_up=True))
    ranked = rank_cells(cells)
    ranked = ranked.join(cells.select("cell_id", *keep), "cell_id") if keep else ranked
    scored, names = mv.decision_scores(ranked, "cell_id", FIELDS, LENSES, keep)
    return mv.multiverse(scored, "cell_id", names)


@query("rank_component_scores", "X14 W5 P28", "cell_id:i heat elderly cooling intensity score", c.with_(SCORED) + """
    SELECT cell_id, heat_gp AS heat, qmargin AS elderly, cooling, intensity, d.score FROM rk JOIN dec d USING (cell_id)
    WHERE d.heat_field = 'gp' AND d.weight_scenario = 'baseline' AND d.population_lens = 'qmargin'""")
def rank_component_scores(t: Tables) -> DataFrame:
    r = ranked_cells(t)
    return r.select("cell_id", F.col("heat_gp").alias("heat"), F.col("qmargin").alias("elderly"), "cooling", "intensity",
                    sl.score("heat_gp", "qmargin", "cooling", "intensity", W["baseline"]).alias("score"))


@query("composite_heat_scores", "X14", "cell_id:i heat score", c.with_(RANKED) + """
    SELECT cell_id, (heat_gp + heat_idw) / 2 AS heat, round(100.0 * ((heat_gp + heat_idw) / 2 * 0.4::DOUBLE + qmargin * 0.3::DOUBLE + cooling * 0.2::DOUBLE + intensity * 0.1::DOUBLE), 9) AS score FROM rk""")
def composite_heat_scores(t: Tables) -> DataFrame:
    h = (F.col("heat_gp") + F.col("heat_idw")) / 2
    return ranked_cells(t).select("cell_id", h.alias("heat"), sl.score(h, "qmargin", "cooling", "intensity", W["baseline"]).alias("score"))


@query("weight_scenario_summary", "P28 J6", "weight_scenario:s n:i mean_score max_score", c.with_(SCORED_PLAIN) + """
    SELECT weight_scenario, count(*) AS n, avg(score) AS mean_score, max(score) AS max_score FROM dec GROUP BY 1""")
def weight_scenario_summary(t: Tables) -> DataFrame:
    return decisions(t, ties_up=False).groupBy("weight_scenario").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))


@query("decision_table", "R13 J18 Q21", "heat_field:s weight_scenario:s population_lens:s share n_selected:i overlap:i jaccard selected_population", c.with_(SCORED) + """
    SELECT heat_field, weight_scenario, population_lens, share, count(*) FILTER (selected) AS n_selected, count(*) FILTER (selected AND baseline) AS overlap,
           count(*) FILTER (selected AND baseline)::DOUBLE / nullif(count(*) FILTER (selected OR baseline), 0) AS jaccard,
           sum(CASE WHEN selected THEN residents ELSE 0 END) AS selected_population
    FROM sel JOIN cells USING (cell_id) GROUP BY ALL""")
def decision_table(t: Tables) -> DataFrame:
    return mv.decision_table(selections(t, ["residents"]), "residents")


_FREQ = """fr AS MATERIALIZED (SELECT cell_id, share, bool_or(baseline) AS baseline, avg(selected::INT) AS freq_all,
    avg(selected::INT) FILTER (heat_field = 'gp' AND population_lens = 'qmargin') AS freq_weights,
    avg(selected::INT) FILTER (heat_field = 'gp' AND weight_scenario = 'baseline') AS freq_lenses,
    avg(selected::INT) FILTER (weight_scenario = 'baseline' AND population_lens = 'qmargin') AS freq_fields,
    avg(selected::INT) FILTER (heat_field = 'gp' AND population_lens = 'qmargin' AND starts_with(weight_scenario, 'leave_out_')) AS freq_leave_one_out
    FROM sel GROUP BY 1, 2)"""


@query("selection_frequencies", "R13 Q21", "cell_id:i share baseline:b freq_all freq_weights freq_lenses freq_fields freq_leave_one_out",
       c.with_(SCORED, _FREQ) + "SELECT * FROM fr")
def selection_frequencies(t: Tables) -> DataFrame:
    return mv.selection_frequency(selections(t))


@query("multiverse_summary", "R13 Q21 Q26", "scope:s share n_cells:i n_baseline:i n_ge_80:i n_ge_90:i n_always:i n_baseline_ge_80:i n_baseline_ge_90:i",
       c.with_(SCORED, _FREQ) + """
    SELECT scope, share, count(*) AS n_cells, count(*) FILTER (baseline) AS n_baseline, count(*) FILTER (f >= 0.8) AS n_ge_80, count(*) FILTER (f >= 0.9) AS n_ge_90,
           count(*) FILTER (f >= 1 - 1e-9) AS n_always, count(*) FILTER (baseline AND f >= 0.8) AS n_baseline_ge_80, count(*) FILTER (baseline AND f >= 0.9) AS n_baseline_ge_90
    FROM (SELECT share, baseline, unnest(['freq_all', 'freq_weights', 'freq_lenses', 'freq_fields', 'freq_leave_one_out']) AS scope,
                 unnest([freq_all, freq_weights, freq_lenses, freq_fields, freq_leave_one_out]) AS f FROM fr) GROUP BY 1, 2""")
def multiverse_summary(t: Tables) -> DataFrame:
    return sl.frequency_summary(mv.selection_frequency(selections(t)))


_SIG = """sg AS (SELECT heat_field, weight_scenario, population_lens, count(*) AS n,
    sum(CAST('0x' || substr(md5(cell_id || ':' || CAST(round(score * 1e6) AS BIGINT)), 1, 12) AS BIGINT))::VARCHAR AS signature FROM dec GROUP BY 1, 2, 3),
  sd AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY heat_field, weight_scenario, population_lens) > 1 AS duplicate FROM sg)"""


@query("duplicate_decisions", "R14 Q19", "heat_field:s weight_scenario:s population_lens:s n:i signature:s duplicate:b", c.with_(SCORED, _SIG) + "SELECT * FROM sd")
def duplicate_decisions(t: Tables) -> DataFrame:
    return sl.decision_signatures(decisions(t), "cell_id")


@query("distinct_decision_frequency", "R14 Q19", "cell_id:i share frequency", c.with_(SCORED, _SIG) + """
    SELECT cell_id, share, avg(selected::INT) AS frequency FROM sel JOIN sd USING (heat_field, weight_scenario, population_lens) WHERE NOT duplicate GROUP BY 1, 2""")
def distinct_decision_frequency(t: Tables) -> DataFrame:
    sel = selections(t)
    keep = {tuple(r[c] for c in sl.DECISION) for r in mv.signatures(sel).where(~F.col("duplicate")).collect()}  # a row per decision
    return mv.frequencies(sel, {"frequency": sel.axis(lambda *name: name in keep)})


#: Draws of an uncertain screen, and correlations between the errors of its layers.
DRAWS, RHOS = 2000, (0.0, 0.5, 0.9, 0.95, 1.0)
_SHARES = ", ".join(f"({v}::DOUBLE)" for v in sl.TOP_SHARES)
_MC = f"""nz AS MATERIALIZED ({lanes.normals_sql({'z': 'mc'}, 'cells', 'cell_id', DRAWS)}),
  dr AS (SELECT cell_id, replicate, round(c.heat_gp + heat_sd * z, 6) AS d, rk.qmargin AS e, rk.cooling AS co, rk.intensity AS i FROM nz JOIN cells c USING (cell_id) JOIN rk USING (cell_id)),
  ms AS (SELECT cell_id, replicate, round(100.0 * ({c.rank_avg('d', 'replicate')} / count(*) OVER (PARTITION BY replicate) * 0.4::DOUBLE + e * 0.3::DOUBLE + co * 0.2::DOUBLE + i * 0.1::DOUBLE), 9) AS score FROM dr),
  mr AS (SELECT cell_id, row_number() OVER (PARTITION BY replicate ORDER BY score DESC, cell_id) AS rn, count(*) OVER (PARTITION BY replicate) AS n FROM ms)"""


def mc_input(t: Tables) -> DataFrame:
    r = ranked_cells(t, ties_up=False).select("cell_id", F.col("qmargin").alias("elderly"), "cooling", "intensity")
    return settled(r.join(m.screen_cells(t).select("cell_id", F.col("heat_gp").alias("mu"), F.col("heat_sd").alias("sd"),
                                                   F.col("canopy").alias("mu2"), F.lit(5.0).alias("sd2"), F.col("heat_idw").alias("mu3"),
                                                   (F.col("heat_sd") / 10).alias("sd3")), "cell_id"))


@query("selection_under_uncertainty", "R11 Q21", "cell_id:i share frequency", c.with_(RANKED_PLAIN, _MC) + f"""
    SELECT cell_id, share, sum((rn <= ceil(round(share * n, 9)))::INT)::DOUBLE / {DRAWS} AS frequency FROM mr, (VALUES {_SHARES}) s(share) GROUP BY 1, 2""")
def selection_under_uncertainty(t: Tables) -> DataFrame:
    return uncertain.selection_frequency(mc_input(t), "cell_id", [uncertain.Outcome("mu", "sd", "mc")], W["baseline"], sl.TOP_SHARES, DRAWS)


_MC3 = f"""n3 AS MATERIALIZED ({lanes.normals_sql({'s': 'm3s', 'i0': 'm3i0', 'i1': 'm3i1', 'i2': 'm3i2'}, 'cells', 'cell_id', DRAWS)}),
  d3 AS (SELECT cell_id, replicate, rho, round(c.heat_gp + heat_sd * (sqrt(rho) * s + sqrt(1 - rho) * i0), 6) AS a,
      round(greatest(0, least(100, canopy + 5 * (sqrt(rho) * s + sqrt(1 - rho) * i1))), 6) AS b,
      round(c.heat_idw + heat_sd / 10 * (sqrt(rho) * s + sqrt(1 - rho) * i2), 6) AS d
      FROM n3 JOIN cells c USING (cell_id), (VALUES {', '.join(f'({r}::DOUBLE)' for r in RHOS)}) r(rho)),
  s3 AS (SELECT cell_id, replicate, rho, n, round(100.0 * (({c.rank_avg('a', 'replicate, rho')} / n + {c.rank_avg('b', 'replicate, rho')} / n + {c.rank_avg('d', 'replicate, rho')} / n) / 3 * 0.4::DOUBLE
      + qmargin * 0.3::DOUBLE + cooling * 0.2::DOUBLE + intensity * 0.1::DOUBLE), 9) AS score
      FROM (SELECT d3.*, count(*) OVER (PARTITION BY replicate, rho) AS n, qmargin, cooling, intensity FROM d3 JOIN rk USING (cell_id))),
  r3 AS (SELECT cell_id, rho, n, row_number() OVER (PARTITION BY replicate, rho ORDER BY score DESC, cell_id) AS rn FROM s3)"""


@query("selection_under_correlated_uncertainty", "R12 P25 Q21", "cell_id:i rho share frequency", c.with_(RANKED_PLAIN, _MC3) + f"""
    SELECT cell_id, rho, share, sum((rn <= ceil(round(share * n, 9)))::INT)::DOUBLE / {DRAWS} AS frequency FROM r3, (VALUES {_SHARES}) s(share) GROUP BY 1, 2, 3""")
def selection_under_correlated_uncertainty(t: Tables) -> DataFrame:
    layers = [uncertain.Outcome("mu", "sd", "m3i0"), uncertain.Outcome("mu2", "sd2", "m3i1", (0.0, 100.0)), uncertain.Outcome("mu3", "sd3", "m3i2")]
    return uncertain.selection_frequencies(mc_input(t), "cell_id", layers, W["baseline"], sl.TOP_SHARES, DRAWS, "m3s", RHOS)


@query("layer_sensitivity", "R15 P25 Q23", "variant:s n_selected:i overlap:i jaccard", c.with_(c.SCREEN_TIES_UP) + f""",
    r AS (SELECT cell_id, {c.rank_avg('heat_gp')} / count(*) OVER () AS g, {c.rank_avg('heat_idw')} / count(*) OVER () AS h, {c.rank_avg('older')} / count(*) OVER () AS e,
          {c.rank_avg('sh')} / count(*) OVER () AS es, 1 - {c.rank_avg('canopy')} / count(*) OVER () AS co, {c.rank_avg('building')} / count(*) OVER () AS i
          FROM (SELECT *, round(greatest(0, least(1, older / residents)), 9) AS sh FROM cells)),
    s AS (SELECT cell_id, unnest(['baseline', 'other_heat_layer', 'population_share']) AS variant,
          unnest([round(100.0 * (g * 0.4::DOUBLE + e * 0.3::DOUBLE + co * 0.2::DOUBLE + i * 0.1::DOUBLE), 9), round(100.0 * (h * 0.4::DOUBLE + e * 0.3::DOUBLE + co * 0.2::DOUBLE + i * 0.1::DOUBLE), 9),
                  round(100.0 * (g * 0.4::DOUBLE + es * 0.3::DOUBLE + co * 0.2::DOUBLE + i * 0.1::DOUBLE), 9)]) AS score FROM r),
    t AS (SELECT cell_id, variant, row_number() OVER (PARTITION BY variant ORDER BY score DESC, cell_id) <= ceil(round(0.1::DOUBLE * count(*) OVER (PARTITION BY variant), 9)) AS selected FROM s),
    b AS (SELECT *, max(CASE WHEN variant = 'baseline' THEN selected END) OVER (PARTITION BY cell_id) AS base FROM t)
    SELECT variant, count(*) FILTER (selected) AS n_selected, count(*) FILTER (selected AND base) AS overlap,
           count(*) FILTER (selected AND base)::DOUBLE / count(*) FILTER (selected OR base) AS jaccard FROM b GROUP BY 1""")
def layer_sensitivity(t: Tables) -> DataFrame:
    share = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("older") / F.col("residents"))), 9)
    r = sl.rank_layers(m.screen_cells(t, ties_up=True).withColumn("share65", share), "cell_id",
                       {"g": "heat_gp", "h": "heat_idw", "e": "older", "es": "share65", "co": "canopy", "i": "building"}, reverse=("co",))
    s = settled(r).select("cell_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("variant"), sl.score(h, e, "co", "i", W["baseline"]).alias("score"))
        for n, h, e in (("baseline", "g", "e"), ("other_heat_layer", "h", "e"), ("population_share", "g", "es"))])))
    f = ranks.top_share(s, "score", 0.1, "cell_id", ["variant"])
    base = f.where("variant = 'baseline'").select("cell_id", F.col("selected").alias("base"))
    j = joins.jaccard(f.join(base, "cell_id"), F.col("selected"), F.col("base"), ["variant"])
    return j.select("variant", F.col("n_a").alias("n_selected"), F.col("n_both").alias("overlap"), "jaccard")


_TIER = SCORED + """, one AS (SELECT cell_id, max(CASE WHEN heat_field = 'gp' THEN score END) AS s1, max(CASE WHEN heat_field = 'idw' THEN score END) AS s2
    FROM dec WHERE weight_scenario = 'baseline' AND population_lens = 'qmargin' GROUP BY 1),
  tq AS (SELECT round(quantile_cont(s1, 0.5), 9) a1, round(quantile_cont(s1, 0.75), 9) b1, round(quantile_cont(s1, 0.9), 9) c1,
                round(quantile_cont(s2, 0.5), 9) a2, round(quantile_cont(s2, 0.75), 9) b2, round(quantile_cont(s2, 0.9), 9) c2 FROM one),
  tt AS (SELECT cell_id, CASE WHEN s1 >= c1 THEN 'highest_priority' WHEN s1 >= b1 THEN 'high_priority' WHEN s1 >= a1 THEN 'elevated_monitoring' ELSE 'baseline_monitoring' END AS tier,
                CASE WHEN s2 >= c2 THEN 'highest_priority' WHEN s2 >= b2 THEN 'high_priority' WHEN s2 >= a2 THEN 'elevated_monitoring' ELSE 'baseline_monitoring' END AS tier2 FROM one, tq)"""


def tiered(t: Tables) -> DataFrame:
    r = ranked_cells(t)
    s = r.select("cell_id", *[sl.score(h, "qmargin", "cooling", "intensity", W["baseline"]).alias(n) for n, h in (("s1", "heat_gp"), ("s2", "heat_idw"))])
    return ranks.tiers(settled(ranks.tiers(settled(s), "s1")), "s2", out="tier2")


@query("tier_report", "X15 W8 Q21", "tier:s tier_order:i n_cells:i residents:f2 mean_canopy:f2 median_refuge:f2", c.with_(_TIER) + """
    SELECT tier, CASE tier WHEN 'highest_priority' THEN 0 WHEN 'high_priority' THEN 1 WHEN 'elevated_monitoring' THEN 2 ELSE 3 END AS tier_order, count(*) AS n_cells,
           round(sum(residents), 2) AS residents, round(avg(canopy), 2) AS mean_canopy, round(quantile_cont(refuge_m, 0.5), 2) AS median_refuge
    FROM tt JOIN cells USING (cell_id) GROUP BY tier""")
def tier_report(t: Tables) -> DataFrame:
    df = settled(tiered(t).join(m.screen_cells(t, ties_up=True), "cell_id"))
    med = ranks.exact_quantiles(df, "tier", "refuge_m", (0.5,)).select("tier", F.round("quantile", 2).alias("median_refuge"))
    rep = sl.tier_report(df, "tier", {"residents": "residents"}, {"mean_canopy": F.avg("canopy")}, ranks.TIERS[::-1])
    return rep.join(med, "tier")


_DECIRC = tuple(0.0 if n == "cooling" else w for n, w in zip(sl.COMPONENTS, sl.BASE_WEIGHTS["baseline"], strict=True))
DECIRC = tuple(v / sum(_DECIRC) for v in _DECIRC)


@query("tiers_without_cooling", "X15 W8 Q21", "specification:s tier:s tier_order:i n_cells:i residents:f2 median_refuge:f2", c.with_(RANKED) + f""",
    sc AS (SELECT cell_id, unnest(['with_cooling', 'without_cooling']) AS specification,
           unnest([round(100.0 * (heat_gp * 0.4::DOUBLE + qmargin * 0.3::DOUBLE + cooling * 0.2::DOUBLE + intensity * 0.1::DOUBLE), 9),
                   round(100.0 * (heat_gp * {DECIRC[0]!r}::DOUBLE + qmargin * {DECIRC[1]!r}::DOUBLE + cooling * {DECIRC[2]!r}::DOUBLE + intensity * {DECIRC[3]!r}::DOUBLE), 9)]) AS s FROM rk),
    tq AS (SELECT specification, round(quantile_cont(s, 0.5), 9) a, round(quantile_cont(s, 0.75), 9) b, round(quantile_cont(s, 0.9), 9) c FROM sc GROUP BY 1),
    tt AS (SELECT cell_id, specification, CASE WHEN s >= c THEN 'highest_priority' WHEN s >= b THEN 'high_priority' WHEN s >= a THEN 'elevated_monitoring' ELSE 'baseline_monitoring' END AS tier FROM sc JOIN tq USING (specification))
    SELECT specification, tier, CASE tier WHEN 'highest_priority' THEN 0 WHEN 'high_priority' THEN 1 WHEN 'elevated_monitoring' THEN 2 ELSE 3 END AS tier_order, count(*) AS n_cells,
           round(sum(residents), 2) AS residents, round(quantile_cont(refuge_m, 0.5), 2) AS median_refuge FROM tt JOIN cells USING (cell_id) GROUP BY ALL""")
def tiers_without_cooling(t: Tables) -> DataFrame:
    """Refuge distance by tier of the score, and of the score without the component that overlaps with it."""
    r, cells, parts = ranked_cells(t), m.screen_cells(t, ties_up=True), []
    for name, w in (("with_cooling", W["baseline"]), ("without_cooling", DECIRC)):
        tier = ranks.tiers(settled(r.select("cell_id", sl.score("heat_gp", "qmargin", "cooling", "intensity", w).alias("s"))), "s")
        df = settled(tier.join(cells, "cell_id"))
        med = ranks.exact_quantiles(df, "tier", "refuge_m", (0.5,)).select("tier", F.round("quantile", 2).alias("median_refuge"))
        rep = sl.tier_report(df, "tier", {"residents": "residents"}, {}, ranks.TIERS[::-1])
        parts.append(rep.join(med, "tier").withColumn("specification", F.lit(name)))
    return joins.union_all(*parts)


@query("tier_transitions", "A13 Q26", "tier:s highest_priority:i high_priority:i elevated_monitoring:i baseline_monitoring:i", c.with_(_TIER) + """
    SELECT tier, count(*) FILTER (tier2 = 'highest_priority') AS highest_priority, count(*) FILTER (tier2 = 'high_priority') AS high_priority,
           count(*) FILTER (tier2 = 'elevated_monitoring') AS elevated_monitoring, count(*) FILTER (tier2 = 'baseline_monitoring') AS baseline_monitoring FROM tt GROUP BY 1""")
def tier_transitions(t: Tables) -> DataFrame:
    return ag.pivot_fill(tiered(t), "tier", "tier2", ranks.TIERS[::-1], F.count(F.lit(1)))


@query("screen_agreement", "J18 T2 Q21", "n_a:i n_b:i n_both:i n_either:i jaccard rho", c.with_(_TIER) + f"""
    SELECT count(*) FILTER (tier = 'highest_priority') AS n_a, count(*) FILTER (tier2 = 'highest_priority') AS n_b,
           count(*) FILTER (tier = 'highest_priority' AND tier2 = 'highest_priority') AS n_both, count(*) FILTER (tier = 'highest_priority' OR tier2 = 'highest_priority') AS n_either,
           count(*) FILTER (tier = 'highest_priority' AND tier2 = 'highest_priority')::DOUBLE / count(*) FILTER (tier = 'highest_priority' OR tier2 = 'highest_priority') AS jaccard,
           (SELECT corr(a, b) FROM (SELECT {c.rank_avg('s1')} a, {c.rank_avg('s2')} b FROM one)) AS rho FROM tt""")
def screen_agreement(t: Tables) -> DataFrame:
    df = settled(tiered(t))
    hit = lambda col: F.col(col) == ranks.TIERS[-1]
    rho = at.corr_matrix_any_size(df, ["s1", "s2"]).select("r").scalar()
    return joins.jaccard(df, hit("tier"), hit("tier2")).withColumn("rho", rho)


@query("frequency_histogram", "A20 Q26", "bin:i lo hi n:i", c.with_(SCORED, _FREQ) + """,
    e AS (SELECT unnest([0, 0.25, 0.5, 0.75, 0.9]) AS lo, unnest([0.25, 0.5, 0.75, 0.9, 1.0001]) AS hi, unnest(range(5)) AS bin)
    SELECT bin, lo, hi, count(*) AS n FROM fr JOIN e ON baseline AND share = 0.1 AND freq_all >= lo AND freq_all < hi GROUP BY ALL""")
def frequency_histogram(t: Tables) -> DataFrame:
    f = mv.selection_frequency(selections(t)).where("baseline AND share = 0.1")
    return ag.histogram(f, "freq_all", [0, 0.25, 0.5, 0.75, 0.9, 1.0001])
