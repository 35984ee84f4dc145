"""SQL texts of the sensor-network views, for the SQL twins."""

from __future__ import annotations

from duskline.sources.mapping import TIES_UP

READINGS = """readings AS (
  SELECT event_id, 'S' || (user_id % 20) AS station, ts, event_type, value,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS qc,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS rc
  FROM events)"""

CLEAN = READINGS + """, clean AS (
  SELECT *, timezone('Europe/Berlin', timezone('UTC', ts)) AS loc_ts
  FROM readings WHERE qc = 0 AND value BETWEEN -30 AND 300)"""

SLOTS = """slots AS (
  SELECT * FROM (
    SELECT 'S' || (l_suppkey % 10) AS station,
           l_shipdate + (19 + l_linenumber) * INTERVAL 1 HOUR AS loc_ts,
           l_extendedprice / l_quantity / 100.0 AS value
    FROM lineitem) WHERE value BETWEEN -30 AND 50)"""


def station_nights(name="sn", start=20, end=8, min_samples=1, src="slots", extra_having="") -> str:
    return f"""{name} AS (
  SELECT *, -(t_early - t_late) / 4.0 AS cool_rate, t_even - night_min AS cool_total,
         year(night_date) AS year, month(night_date) AS month, dayofyear(night_date) AS doy
  FROM (
    SELECT station, night_date, count(*) AS n_samples,
           round(min(value), 9) AS night_min, round(avg(value), 9) AS night_mean, round(max(value), 9) AS night_max,
           round(avg(CASE WHEN hour(loc_ts) IN (20, 21) THEN value END), 9) AS t_even,
           round(avg(CASE WHEN hour(loc_ts) IN (22, 23) THEN value END), 9) AS t_late,
           round(avg(CASE WHEN hour(loc_ts) IN (1, 2) THEN value END), 9) AS t_early
    FROM (SELECT *, CASE WHEN hour(loc_ts) >= {start} THEN CAST(loc_ts AS DATE)
                         ELSE CAST(loc_ts - INTERVAL 1 DAY AS DATE) END AS night_date
          FROM {src} WHERE hour(loc_ts) >= {start} OR hour(loc_ts) < {end})
    WHERE month(night_date) IN (6, 7, 8)
    GROUP BY station, night_date HAVING count(*) >= {min_samples}{extra_having}))"""


def city_nights(name="city", sn="sn", min_stations=3) -> str:
    return f"""{name} AS (
  SELECT night_date, count(*) AS n_stations,
         round(avg(night_min), 9) AS warmth, round(quantile_cont(night_min, 0.5), 9) AS median_tmin,
         round(stddev_samp(night_min), 9) AS sd_tmin,
         round(quantile_cont(night_min, 0.9) - quantile_cont(night_min, 0.1), 9) AS p90p10_tmin,
         round(quantile_cont(night_min, 0.75) - quantile_cont(night_min, 0.25), 9) AS iqr_tmin,
         round(max(night_min) - min(night_min), 9) AS range_tmin,
         avg(CASE WHEN night_min >= 18 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS frac_ge18,
         avg(CASE WHEN night_min >= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS frac_ge20,
         round(avg(cool_rate), 9) AS mean_cool_rate, round(stddev_samp(cool_rate), 9) AS sd_cool_rate,
         round(quantile_cont(cool_rate, 0.9) - quantile_cont(cool_rate, 0.1), 9) AS p90p10_cool_rate,
         round(avg(cool_total), 9) AS mean_cool_total, round(stddev_samp(cool_total), 9) AS sd_cool_total,
         count(cool_rate) AS n_cool_rate
  FROM {sn} GROUP BY night_date HAVING count(*) >= {min_stations})"""


DAILY_WEATHER = """daily_weather AS (
  SELECT CAST(o_orderdate AS DATE) AS night_date,
         round(avg(o_totalprice) / 1000, 9) AS day_rad,
         round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 1000, 9) AS clearness,
         CAST(count(*) AS DOUBLE) AS wind, avg(CAST(o_custkey % 100 AS DOUBLE)) AS rh,
         avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS precip
  FROM orders WHERE month(o_orderdate) IN (6, 7, 8) GROUP BY 1)"""

WEATHER = DAILY_WEATHER + """, wtrain AS (
  SELECT avg(clearness) mc, stddev_samp(clearness) sc, avg(wind) mw, stddev_samp(wind) sw
  FROM daily_weather WHERE year(night_date) BETWEEN 1995 AND 1998),
windex AS (
  SELECT d.*, (clearness - mc) / sc AS z_clearness, (wind - mw) / sw AS z_wind,
         round(((clearness - mc) / sc - (wind - mw) / sw) / 2, 9) AS calm_clear_index
  FROM daily_weather d, wtrain),
wcut AS (
  SELECT round(quantile_cont(calm_clear_index, 1.0/3), 9) lo, round(quantile_cont(calm_clear_index, 2.0/3), 9) hi
  FROM windex WHERE year(night_date) BETWEEN 1995 AND 1998),
weather AS (
  SELECT w.*, CASE WHEN calm_clear_index >= hi THEN 'calm_clear' WHEN calm_clear_index <= lo THEN 'cloudy_windy'
                   ELSE 'mixed' END AS regime
  FROM windex w, wcut)"""

PANEL = SLOTS + ", " + station_nights() + ", " + city_nights()

NIGHTS = PANEL + ", " + WEATHER + """, nights AS MATERIALIZED (
  SELECT c.*, w.* EXCLUDE (night_date), year(c.night_date) AS year FROM city c JOIN weather w USING (night_date))"""

CALENDAR = """calendar AS (
  SELECT y.year, CAST(d.day AS DATE) AS night_date,
         datediff('day', make_date(y.year, 6, 1), CAST(d.day AS DATE)) AS day_index
  FROM (SELECT CAST(unnest(range(1995, 2002)) AS BIGINT) AS year) y,
       LATERAL (SELECT unnest(generate_series(make_date(y.year, 6, 1)::TIMESTAMP, make_date(y.year, 8, 31)::TIMESTAMP,
                                              INTERVAL 1 DAY)) AS day) d)"""

STATIONS = """stations AS (
  SELECT vec_id AS station_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y,
         embedding[3]::DOUBLE AS target, embedding[8]::DOUBLE AS elevation, embedding[9]::DOUBLE AS building,
         embedding[10]::DOUBLE AS canopy, CAST(label AS BIGINT) AS block
  FROM embeddings)"""

GRID = """grid AS (
  SELECT vec_id AS cell_id, embedding[4]::DOUBLE * 1000 AS cx, embedding[5]::DOUBLE * 1000 AS cy,
         embedding[6]::DOUBLE AS field_a, embedding[7]::DOUBLE AS field_b, CAST(label AS BIGINT) AS region
  FROM embeddings)"""

SCREEN = """cells AS MATERIALIZED (
  SELECT p_partkey AS cell_id, CAST(p_size AS DOUBLE) AS canopy, p_retailprice AS building,
         CAST(length(p_name) AS DOUBLE) * 10 + p_size AS refuge_m, a.* EXCLUDE (l_partkey)
  FROM part JOIN (
    SELECT l_partkey, round(avg(l_extendedprice), 6) AS heat_gp,
           round(avg(l_extendedprice / l_quantity), 6) AS heat_idw,
           round(coalesce(stddev_samp(l_extendedprice), 0), 6) AS heat_sd,
           sum(l_quantity) AS residents,
           sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS older,
           sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS older_lower
    FROM lineitem GROUP BY l_partkey) a ON p_partkey = l_partkey)"""

# The same cells, halves of the sixth digit of a heat layer rounded up.
SCREEN_TIES_UP = SCREEN.replace("round(avg(l_extendedprice), 6)", f"round(avg(l_extendedprice) + {TIES_UP}::DOUBLE, 6)").replace(
    "round(avg(l_extendedprice / l_quantity), 6)", f"round(avg(l_extendedprice / l_quantity) + {TIES_UP}::DOUBLE, 6)")


def rank_avg(expr: str, by: str = "") -> str:
    """Average-tie rank."""
    part = f"PARTITION BY {by} " if by else ""
    full = f"{by}, {expr}" if by else expr
    return (f"(rank() OVER ({part}ORDER BY {expr}) + (count(*) OVER (PARTITION BY {full}) - 1) / 2.0::DOUBLE)")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def partial_sql(name: str, src: str, by: str, x: str, y: str, covs=(), min_n: int = 3, raw=(), use: dict[str, str] | None = None) -> str:
    """CTEs computing a partial rank correlation per group by the recursive formula.

    src must hold listwise-complete rows. use maps a covariate to a boolean
    expression: where false, the covariate takes no part.
    """
    use = use or {}
    vals = [f"{rank_avg(x, by)} AS v0", f"{rank_avg(y, by)} AS v1"]
    for i, cov in enumerate(covs):
        v = f"CAST({cov} AS DOUBLE)" if cov in raw else rank_avg(cov, by)
        vals.append(f"CASE WHEN {use.get(cov, 'true')} THEN {v} ELSE 0 END AS v{i + 2}")
    names = [f"v{i}" for i in range(len(covs) + 2)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    cc = lambda a, b: f"coalesce(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE corr({a}, {b}) END, 0) AS {a}{b}"
    out = [f"{name}_r AS (SELECT {by}, {', '.join(vals)} FROM {src})",
           f"{name}_0 AS (SELECT {by}, count(*) AS n, {', '.join(cc(a, b) for a, b in pairs)} FROM {name}_r GROUP BY {by})"]
    left = names
    for i in range(2, len(names)):
        z = names[i]
        left = [v for v in left if v != z]
        key = lambda a, b: f"{a}{b}" if (a, b) in pairs else f"{b}{a}"
        cols = [f"({a}{b} - {key(a, z)} * {key(b, z)}) / nullif(sqrt((1 - {key(a, z)}**2) * (1 - {key(b, z)}**2)), 0) AS {a}{b}"
                for a, b in pairs if a in left and b in left]
        out.append(f"{name}_{i - 1} AS (SELECT {by}, n, {', '.join(cols)} FROM {name}_{i - 2})")
    last = f"{name}_{len(covs)}"
    out.append(f"{name} AS (SELECT {by}, n, CASE WHEN n >= {min_n} THEN v0v1 END AS rho FROM {last})")
    return ", ".join(out)


def resid_sql(name: str, src: str, by: str, covs, keep: str, use: dict[str, str] | None = None, x="x", y="y") -> str:
    """CTEs of rank residuals rx, ry by sequential orthogonalisation."""
    use = use or {}
    cs = [f"CASE WHEN {use.get(cv, 'true')} THEN {rank_avg(cv, by)} ELSE 0 END AS c{i}" for i, cv in enumerate(covs)]
    out = [f"{name}_0 AS (SELECT {by}, {keep}, {', '.join([rank_avg(x, by) + ' AS rx', rank_avg(y, by) + ' AS ry', *cs])} FROM {src})"]
    for i in range(len(covs)):
        rest = ["rx", "ry"] + [f"c{j}" for j in range(i + 1, len(covs))]
        w = f"OVER (PARTITION BY {by})"
        cols = [f"{v} - CASE WHEN var_pop(c{i}) {w} > 1e-9 THEN covar_pop({v}, c{i}) {w} / var_pop(c{i}) {w} ELSE 0 END * (c{i} - avg(c{i}) {w}) AS {v}"
                for v in rest]
        out.append(f"{name}_{i + 1} AS (SELECT {by}, {keep}, {', '.join(cols)} FROM {name}_{i})")
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_{len(covs)})")
    return ", ".join(out)


def linear_resid_sql(name: str, src: str, targets, covs, by: str = "", keep: str = "") -> str:
    """CTEs ending in `name`: targets with the covariates' least-squares part taken off, one covariate after another, in each group."""
    head = ", ".join(x for x in (by, keep) if x)
    head = head + ", " if head else ""
    w = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    left = [*targets, *covs]
    out = [f"{name}_0 AS MATERIALIZED (SELECT {head}{', '.join(f'CAST({v} AS DOUBLE) - avg(CAST({v} AS DOUBLE)) {w} AS {v}' for v in left)} FROM {src})"]
    for i, z in enumerate(covs):
        left = [v for v in left if v != z]
        cols = [f"{v} - CASE WHEN var_pop({z}) {w} > 1e-12 THEN covar_pop({v}, {z}) {w} / var_pop({z}) {w} ELSE 0 END * {z} AS {v}" for v in left]
        out.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT {head}{', '.join(cols)} FROM {name}_{i})")
    out.append(f"{name} AS (SELECT * FROM {name}_{len(covs)})")
    return ", ".join(out)


def hac_terms_sql(name: str, src: str, by: str, y: str, xs, lags: int, order="night_date") -> str:
    """CTEs ending in `name`({by}, term, beta, se, p, n): several-regressor Newey-West fit, each coefficient from its regressor's residual on the others."""
    xs, out, union = list(xs), [], []
    on = " AND ".join(f"a.{b} = b.{b}" for b in by.split(", "))
    out.append(linear_resid_sql(f"{name}_e", src, [y], xs, by, order))
    for i, x in enumerate(xs):
        others = [v for v in xs if v != x]
        out.append(linear_resid_sql(f"{name}_x{i}", src, [x, y], others, by, order))
        out.append(f"""{name}_z{i} AS MATERIALIZED (SELECT r.{by.replace(', ', ', r.')}, r.{order}, r.{x} AS xr, r.{y} AS yr, r.{x} * e.{y} AS z, row_number() OVER (PARTITION BY {by} ORDER BY r.{order}) AS p
          FROM {name}_x{i} r JOIN {name}_e e USING ({by}, {order}))""")
        out.append(f"""{name}_m{i} AS (SELECT a.{by.replace(', ', ', a.')}, sum(CASE WHEN a.p = b.p THEN a.z * a.z ELSE 2 * (1 - (a.p - b.p) / {lags + 1}.0::DOUBLE) * a.z * b.z END) AS meat
          FROM {name}_z{i} a JOIN {name}_z{i} b ON {on} AND a.p - b.p BETWEEN 0 AND {lags} GROUP BY ALL)""")
        union.append(f"""SELECT {by}, '{x}' AS term, beta, se, {normal_p('beta / se')} AS p, n FROM (
          SELECT {by}, sum(xr * yr) / sum(xr * xr) AS beta, sqrt(greatest(0, any_value(meat))) / sum(xr * xr) AS se, count(*) AS n FROM {name}_z{i} JOIN {name}_m{i} USING ({by}) GROUP BY {by})""")
    # with regressors centred in the group, the constant's own residual is one
    out.append(f"{name}_zc AS MATERIALIZED (SELECT e.{by.replace(', ', ', e.')}, e.{y} AS z, s.{y} AS yr, row_number() OVER (PARTITION BY {by} ORDER BY e.{order}) AS p FROM {name}_e e JOIN {src} s USING ({by}, {order}))")
    out.append(f"""{name}_mc AS (SELECT a.{by.replace(', ', ', a.')}, sum(CASE WHEN a.p = b.p THEN a.z * a.z ELSE 2 * (1 - (a.p - b.p) / {lags + 1}.0::DOUBLE) * a.z * b.z END) AS meat
      FROM {name}_zc a JOIN {name}_zc b ON {on} AND a.p - b.p BETWEEN 0 AND {lags} GROUP BY ALL)""")
    union.append(f"""SELECT {by}, 'intercept' AS term, beta, se, {normal_p('beta / se')} AS p, n FROM (
      SELECT {by}, round(avg(yr), 12) AS beta, sqrt(greatest(0, any_value(meat))) / count(*) AS se, count(*) AS n FROM {name}_zc JOIN {name}_mc USING ({by}) GROUP BY {by})""")
    return ", ".join(out) + f", {name} AS ({' UNION ALL '.join(union)})"


def shift_sql(name: str, src: str, by: str, strata: int, x="rx", y="ry", order="night_date", group="year") -> str:
    """CTEs of the exact stratified shift p with a fixed number of strata per test."""
    half = strata // 2
    combos = lambda lo, hi: (
        f"SELECT {by}, {' + '.join(f's{g}.v' for g in range(lo, hi))} AS v FROM (SELECT {by}, v FROM {name}_s WHERE gi = {lo}) s{lo} "
        + " ".join(f"JOIN (SELECT {by}, v FROM {name}_s WHERE gi = {g}) s{g} USING ({by})" for g in range(lo + 1, hi)))
    return f"""{name}_c AS (SELECT *, {x} - avg({x}) OVER (PARTITION BY {by}) AS cx, {y} - avg({y}) OVER (PARTITION BY {by}) AS cy,
      dense_rank() OVER (PARTITION BY {by} ORDER BY {group}) AS gi,
      row_number() OVER (PARTITION BY {by}, {group} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {by}, {group}) AS m FROM {src}),
    {name}_s AS MATERIALIZED (SELECT a.{by.replace(', ', ', a.')}, a.gi, (b.i - a.i + a.m) % a.m AS sh, sum(a.cx * b.cy) AS v
      FROM {name}_c a JOIN {name}_c b USING ({by}, gi) GROUP BY ALL),
    {name}_t AS (SELECT {by}, sqrt(sum(cx * cx) * sum(cy * cy)) AS denom, count(*) AS n FROM {name}_c GROUP BY {by}),
    {name}_o AS (SELECT {by}, sum(v) AS obs FROM {name}_s WHERE sh = 0 GROUP BY {by}),
    {name}_k AS (SELECT {by}, n, denom, greatest(0, abs(obs) - 1e-12 * denom) AS cut FROM {name}_t JOIN {name}_o USING ({by})),
    {name}_l AS ({combos(1, half + 1)}),
    {name}_q AS MATERIALIZED (SELECT {by}, v, max(rn) AS upto, min(rn) AS fromn, max(tot) AS tot FROM (
       SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY v) AS rn, count(*) OVER (PARTITION BY {by}) AS tot
       FROM ({combos(half + 1, strata + 1)})) GROUP BY {by}, v),
    {name}_lo AS (SELECT l.{by.replace(', ', ', l.')}, sum(coalesce(q.upto, 0)) AS c, count(*) AS nl FROM (SELECT *, -cut - v AS th FROM {name}_l JOIN {name}_k USING ({by})) l
       ASOF LEFT JOIN {name}_q q ON {' AND '.join(f'l.{b} = q.{b}' for b in by.split(', '))} AND l.th >= q.v GROUP BY ALL),
    {name}_hi AS (SELECT l.{by.replace(', ', ', l.')}, sum(coalesce(q.tot - q.fromn + 1, 0)) AS c FROM (SELECT *, cut - v AS th FROM {name}_l JOIN {name}_k USING ({by})) l
       ASOF LEFT JOIN {name}_q q ON {' AND '.join(f'l.{b} = q.{b}' for b in by.split(', '))} AND l.th <= q.v GROUP BY ALL),
    {name} AS (SELECT {by}, k.n, CASE WHEN cut = 0 THEN 1.0 ELSE (lo.c + hi.c)::DOUBLE / (nl::DOUBLE * qt.tot) END AS p_shift,
       nl::DOUBLE * qt.tot AS n_randomizations
       FROM {name}_k k JOIN {name}_lo lo USING ({by}) JOIN {name}_hi hi USING ({by}) JOIN (SELECT {by}, max(tot) AS tot FROM {name}_q GROUP BY {by}) qt USING ({by}))"""


NORMAL_P = """(2 * CASE WHEN abs({z}) > 37 THEN 0 WHEN abs({z}) < 7.07106781186547 THEN exp(-({z})*({z})/2) *
  ((((((3.52624965998911e-02*abs({z})+0.700383064443688)*abs({z})+6.37396220353165)*abs({z})+33.912866078383)*abs({z})+112.079291497871)*abs({z})+221.213596169931)*abs({z})+220.206867912376) /
  (((((((8.83883476483184e-02*abs({z})+1.75566716318264)*abs({z})+16.064177579207)*abs({z})+86.7807322029461)*abs({z})+296.564248779674)*abs({z})+637.333633378831)*abs({z})+793.826512519948)*abs({z})+440.413735824752)
  ELSE exp(-({z})*({z})/2) / (abs({z}) + 1/(abs({z}) + 2/(abs({z}) + 3/(abs({z}) + 4/(abs({z}) + 0.65))))) / 2.506628274631 END)"""


def normal_p(z: str) -> str:
    return NORMAL_P.replace("{z}", f"({z})")


def hac_sql(name: str, src: str, by: str, y: str, x: str, lags: int, order="night_date") -> str:
    """CTEs of a one-regressor Newey-West fit per group (src complete in x and y)."""
    on = " AND ".join(f"a.{b} = b.{b}" for b in by.split(", "))
    return f"""{name}_f AS (SELECT {by}, avg({x}) AS mx, avg({y}) AS my, covar_pop({x}, {y}) / var_pop({x}) AS b, var_pop({x}) * count(*) AS sxx,
       var_pop({y}) * count(*) AS tss, count(*) AS n FROM {src} GROUP BY {by}),
    {name}_z AS (SELECT s.*, ({x} - mx) * ({y} - my - b * ({x} - mx)) AS z, ({y} - my - b * ({x} - mx)) AS e,
       row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS p FROM {src} s JOIN {name}_f USING ({by})),
    {name}_m AS (SELECT a.{by.replace(', ', ', a.')}, sum(CASE WHEN a.p = b.p THEN a.z * a.z ELSE 2 * (1 - (a.p - b.p) / {lags + 1}.0::DOUBLE) * a.z * b.z END) AS meat
       FROM {name}_z a JOIN {name}_z b ON {on} AND a.p - b.p BETWEEN 0 AND {lags} GROUP BY ALL),
    {name}_e AS (SELECT {by}, sum(e * e) AS rss FROM {name}_z GROUP BY {by}),
    {name} AS (SELECT {by}, b AS beta, sqrt(greatest(0, meat)) / sxx AS se, {normal_p('b / (sqrt(greatest(0, meat)) / sxx)')} AS p,
       1 - rss / tss AS r2, n FROM {name}_f JOIN {name}_m USING ({by}) JOIN {name}_e USING ({by}))"""


def bh_sql(name: str, src: str, p: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""{name} AS (SELECT *, least(1.0, min(raw) OVER ({part}ORDER BY k DESC)) AS p_bh FROM (
       SELECT *, {p} * count(*) OVER ({part}) / k AS raw FROM (SELECT *, row_number() OVER ({part}ORDER BY {p}) AS k FROM {src})))"""


def draw(seed: str, *keys: str) -> str:
    """SQL of the counter draw, an integer in [0, 2^28)."""
    text = "concat_ws('_', '" + seed + "'" + "".join(f", CAST({k} AS VARCHAR)" for k in keys) + ")"
    return f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"


def normal_draw(seed: str, *keys: str) -> str:
    u, v = f"({draw(seed + 'a', *keys)} / 268435456.0::DOUBLE)", f"({draw(seed + 'b', *keys)} / 268435456.0::DOUBLE)"
    return f"(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}))"


def block_draws(name: str, spine: str, reps: int, seed: str, length="14", by: str = "") -> str:
    """Calendar moving blocks of a spine with year and day_index (and optional by columns)."""
    b = by + ", " if by else ""
    return f"""{name}_s AS (SELECT {b}year, count(*) AS n, least({length}, count(*)) AS L FROM {spine} GROUP BY {b}year{', ' + length if not length.isdigit() and length not in by else ''}),
    {name}_b AS (SELECT {b}year, n, L, replicate, j, {draw(seed, 'replicate', 'year', 'j')} % (n - L + 1) AS start
      FROM (SELECT {b}year, n, L, replicate, unnest(range(CAST(ceil(n / L::DOUBLE) AS BIGINT))) AS j
            FROM {name}_s, (SELECT unnest(range({reps})) AS replicate))),
    {name} AS (SELECT {b}replicate, year, day_index, count(*) AS times FROM (
      SELECT {b}replicate, year, unnest(range(start, start + least(L, n - j * L))) AS day_index FROM {name}_b) GROUP BY ALL)"""


def cluster_draws(name: str, src: str, cluster: str, reps: int, seed: str, by: str = "") -> str:
    b, part = (by + ", ", f"PARTITION BY {by} ") if by else ("", "")
    using = f"USING ({b}i)"
    return f"""{name}_i AS (SELECT {b}{cluster}, row_number() OVER ({part}ORDER BY {cluster}) - 1 AS i,
        count(*) OVER ({part if by else ''}) AS k FROM (SELECT DISTINCT {b}{cluster} FROM {src})),
    {name}_d AS (SELECT {b}replicate, {draw(seed, 'replicate', 'slot')} % k AS i, count(*) AS times
        FROM (SELECT {b}i AS slot, k FROM {name}_i), (SELECT unnest(range({reps})) AS replicate) GROUP BY ALL),
    {name} AS (SELECT {b}replicate, {cluster}, times FROM {name}_d JOIN {name}_i {using})"""
