"""Sources, scan-time functions and input checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.operators.joins import union_all
from duskline.plans import ctes as c
from duskline.plans.registry import query
from duskline.sources import checks, readers
from duskline.sources import mapping as m
from duskline.session import settled
from duskline.sources.tables import TABLES, Tables


@query("parquet_scan_pruned", "S1", "station:s n:i n_value:i lo hi",
       "SELECT 'S' || (user_id % 20) AS station, count(*) AS n, count(value) AS n_value, min(value) AS lo, "
       "max(value) AS hi FROM events GROUP BY 1")
def parquet_scan_pruned(t: Tables) -> DataFrame:
    df = readers.read_readings(t.spark, t.path("events"), ["user_id", "value"])
    return df.groupBy(F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("station")).agg(
        F.count("*").alias("n"), F.count("value").alias("n_value"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("typed_csv_lines", "S2 S7", "event_id:i user_id:i value speed_ms event_type:s", """
    SELECT event_id, user_id, value, value / 3.6 AS speed_ms, event_type FROM events""")
def typed_csv_lines(t: Tables) -> DataFrame:
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"),
                       F.col("value").cast("string"), "event_type")
    parsed = t.events.select(
        F.from_csv(line, "event_id BIGINT, user_id BIGINT, value DOUBLE, event_type STRING").alias("r"))
    return parsed.select("r.*").withColumn("speed_ms", F.col("value") / 3.6)


@query("explicit_timestamp_format", "S3", "event_id:i ts_text:s ts_parsed:t broken:t", """
    SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS ts_text, date_trunc('minute', ts) AS ts_parsed,
           NULL AS broken FROM events""")
def explicit_timestamp_format(t: Tables) -> DataFrame:
    text = F.date_format("ts", "dd.MM.yyyy HH:mm")
    return t.events.select("event_id", text.alias("ts_text"), readers.parse_ts(text, "dd.MM.yyyy HH:mm").alias("ts_parsed"),
                           readers.parse_ts(F.concat(F.lit("x"), text), "dd.MM.yyyy HH:mm").alias("broken"))


@query("lenient_number_coercion", "S4", "event_type:s n:i n_number:i total", """
    SELECT event_type, count(*) AS n, count(v) AS n_number, sum(v) AS total
    FROM (SELECT event_type, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE)
          AS v FROM events) GROUP BY 1""")
def lenient_number_coercion(t: Tables) -> DataFrame:
    raw = t.events.select("event_type", F.when(F.col("event_type") == "error", "n/a")
                          .otherwise(F.col("value").cast("string")).alias("v"))
    return readers.coerce(raw, ["v"]).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("v").alias("n_number"), F.sum("v").alias("total"))


@query("parallel_arrays_to_rows", "S5 D6", "user_id:i day:d ts:t value wind_ms", """
    SELECT user_id, CAST(ts AS DATE) AS day, ts, value, value / 3.6 AS wind_ms FROM events""")
def parallel_arrays_to_rows(t: Tables) -> DataFrame:
    # one document per user and day: arrays stay short however long the archive
    docs = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("ts", "value", "event_id"))).alias("r")
    ).select("user_id", "day", F.to_json(F.struct(
        F.transform("r", lambda r: r["ts"].cast("string")).alias("time"),
        F.transform("r", lambda r: r["value"]).alias("wind"))).alias("doc"))
    parsed = docs.select("user_id", "day", F.from_json("doc", "time ARRAY<STRING>, wind ARRAY<DOUBLE>").alias("h"))
    flat = readers.explode_parallel_arrays(parsed.select("user_id", "day", "h.*"), ["time", "wind"], ["user_id", "day"])
    return flat.select("user_id", "day", F.col("time").cast("timestamp_ntz").alias("ts"), F.col("wind").alias("value"),
                       (F.col("wind") / 3.6).alias("wind_ms"))


@query("collapse_to_grid_keys", "S6 J17", "gx:i gy:i vec_id:i label:i n_requests:i", """
    WITH r AS (SELECT vec_id, label, CAST(floor(embedding[1] * 20) AS BIGINT) AS gx,
                      CAST(floor(embedding[2] * 20) AS BIGINT) AS gy FROM embeddings)
    SELECT gx, gy, min(vec_id) AS vec_id, arg_min(label, vec_id) AS label, count(*) AS n_requests FROM r GROUP BY gx, gy""")
def collapse_to_grid_keys(t: Tables) -> DataFrame:
    e = F.col("embedding")
    req = t.embeddings.select("vec_id", "label", F.floor(F.get(e, F.lit(0)) * 20).alias("gx"),
                              F.floor(F.get(e, F.lit(1)) * 20).alias("gy"))
    kept, mapping = readers.dedupe_by_key(req, ["gx", "gy"], ["vec_id"])
    return kept.join(mapping.groupBy("gx", "gy").agg(F.count("*").alias("n_requests")), ["gx", "gy"])


@query("checksum_manifest", "S10", "status:s n:i key_sum:i", """
    WITH man AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'altered' ELSE sha256(text) END AS expected FROM documents
                 UNION ALL SELECT -1, 'absent')
    SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN sha256(d.text) = m.expected THEN 'ok' ELSE 'mismatch' END AS status,
           count(*) AS n, sum(m.doc_id) AS key_sum
    FROM man m LEFT JOIN documents d USING (doc_id) GROUP BY 1""")
def checksum_manifest(t: Tables) -> DataFrame:
    sums = checks.checksums(t.documents, "doc_id", "text")
    manifest = sums.select("key", F.when(F.col("key") % 50 == 0, "altered").otherwise(F.col("observed")).alias("expected"))
    extra = t.spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit("absent").alias("expected"))
    return checks.validate_manifest(sums, union_all(manifest, extra)).groupBy("status").agg(
        F.count("*").alias("n"), F.sum("key").alias("key_sum"))


@query("file_checksums", "S10 S11", "file:s size:i sha256:s status:s")
def file_checksums(t: Tables) -> DataFrame:
    """Digests of the files of all tables against a manifest that misses one file, names one too many and has one altered digest."""
    roots = [t.path(n) for n in TABLES]
    seen = settled(checks.file_digests(t.spark, roots))
    checks.require_columns(seen, ["path", "size", "sha256"], "file listing")
    file = F.element_at(F.split("path", "/"), -1)
    rule = F.when(file.startswith("region"), F.lit("altered")).otherwise(F.col("sha256"))
    manifest = seen.where(~file.startswith("nation")).select(file.alias("file"), rule.alias("expected"))
    absent = t.spark.range(1).select(F.lit("absent.parquet").alias("file"), F.lit("absent").alias("expected"))
    return checks.verify_files(t.spark, roots, union_all(manifest, absent))


@query("declared_invariants", "S12", "rule:s observed ok:b", """
    WITH a AS (SELECT count(*)::DOUBLE AS row_count, count(DISTINCT station)::DOUBLE AS stations,
                      count(value)::DOUBLE AS values_present, sum(value) AS value_total,
                      year(min(ts))::DOUBLE AS first_year,
                      count(DISTINCT event_id)::DOUBLE AS distinct_ids, max(qc)::DOUBLE AS highest_flag
               FROM (SELECT * FROM (WITH """ + c.READINGS + """ SELECT * FROM readings))),
    l AS (UNPIVOT a ON COLUMNS(*) INTO NAME rule VALUE observed)
    SELECT rule, observed, CASE rule WHEN 'row_count' THEN observed > 0 WHEN 'stations' THEN observed = 20
      WHEN 'values_present' THEN observed > 0 WHEN 'value_total' THEN abs(observed - 1) <= 1e-6
      WHEN 'first_year' THEN observed = 2024 WHEN 'distinct_ids' THEN observed > 0
      ELSE observed BETWEEN 0 AND 6 END AS ok FROM l""")
def declared_invariants(t: Tables) -> DataFrame:
    o = F.col("observed")
    return checks.check_invariants(m.readings(t), {
        "row_count": (F.count("*"), o > 0),
        "stations": (F.countDistinct("station"), o == 20),
        "values_present": (F.count("value"), o > 0),
        "value_total": (F.sum("value"), F.abs(o - 1) <= 1e-6),
        "first_year": (F.year(F.min("ts")), o == 2024),
        "distinct_ids": (F.countDistinct("event_id"), o > 0),
        "highest_flag": (F.max("qc"), o.between(0, 6)),
    })


@query("join_with_cardinality", "S13", "o_orderkey:i o_custkey:i c_nationkey:i c_acctbal", """
    SELECT o_orderkey, o_custkey, c_nationkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_with_cardinality(t: Tables) -> DataFrame:
    cust = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    return checks.checked_join(t.orders, cust, "o_custkey", validate="many_to_one")


@query("duplicate_keys", "S14", "l_orderkey:i l_linenumber:i n:i",
       "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return checks.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("uncovered_dates", "S15 J5", "night_date:d",
       c.with_(c.NIGHTS, c.CALENDAR) + "SELECT night_date FROM calendar EXCEPT SELECT night_date FROM nights")
def uncovered_dates(t: Tables) -> DataFrame:
    return checks.uncovered(m.nights(t), m.calendar(t), "night_date")


@query("finite_value_guard", "S16", "field:s n_bad:i", c.with_(c.PANEL) + """
    SELECT field, CAST(sum(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 1 ELSE 0 END) AS BIGINT) AS n_bad FROM (
      SELECT 'warmth' AS field, warmth AS v FROM city UNION ALL SELECT 'sd_cool_rate', sd_cool_rate FROM city
      UNION ALL SELECT 'sd_cool_total', sd_cool_total FROM city) GROUP BY 1""")
def finite_value_guard(t: Tables) -> DataFrame:
    return checks.not_finite(m.city_nights(t), ["warmth", "sd_cool_rate", "sd_cool_total"])


@query("metric_cross_check", "S17", "comparison:s n:i max_abs_diff n_beyond:i n_null_mismatch:i", c.with_(c.PANEL) + """,
    mean AS (SELECT night_date, sum(night_min) / count(night_min) AS mu FROM sn GROUP BY 1),
    two AS (SELECT night_date, sqrt(sum((night_min - mu) * (night_min - mu)) / nullif(count(night_min) - 1, 0)) AS sd2 FROM sn JOIN mean USING (night_date) GROUP BY 1),
    l AS (SELECT 'two_passes' AS comparison, sd_tmin AS a, sd2 AS b FROM city JOIN two USING (night_date)
          UNION ALL SELECT 'altered', sd_tmin, CASE WHEN day(night_date) % 7 = 0 THEN sd2 + 0.01 WHEN day(night_date) <> 13 THEN sd2 END FROM city JOIN two USING (night_date))
    SELECT comparison, count(*) AS n, max(abs(a - b)) AS max_abs_diff, count(*) FILTER (abs(a - b) > 1e-8) AS n_beyond, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS n_null_mismatch FROM l GROUP BY 1""")
def metric_cross_check(t: Tables) -> DataFrame:
    """The panel's dispersion against a second computation, sums of squared distances from a joined mean; and against altered values, which must be found."""
    sn, city = settled(m.station_nights(t).select("night_date", "night_min")), m.city_nights(t)
    mean = sn.groupBy("night_date").agg((F.sum("night_min") / F.count("night_min")).alias("mu"))
    d = F.col("night_min") - F.col("mu")
    two = sn.join(mean, "night_date").groupBy("night_date").agg(F.sqrt(F.sum(d * d) / F.nullif(F.count("night_min") - 1, F.lit(0))).alias("sd2"))
    day = F.dayofmonth("night_date")
    altered = two.withColumn("sd2", F.when(day % 7 == 0, F.col("sd2") + 0.01).when(day != 13, F.col("sd2")))
    parts = [checks.disagreement(city, other, "night_date", "sd_tmin", "sd2", 1e-8).withColumn("comparison", F.lit(name)) for name, other in (("two_passes", two), ("altered", altered))]
    return union_all(*parts)


@query("metric_register", "S18 D15 Q25", "category:s metric:s numeric_value units:s", c.with_(c.NIGHTS) + """,
    a AS (SELECT 'panel' AS category, count(*)::DOUBLE AS n_station_nights, sum(n_samples)::DOUBLE AS n_readings,
                 count(DISTINCT station)::DOUBLE AS n_stations,
                 100.0 * avg(CASE WHEN cool_rate IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cool_rate_coverage_pct
          FROM sn),
    b AS (SELECT 'nights' AS category, count(*)::DOUBLE AS n_nights,
                 (count(*) FILTER (WHERE regime = 'calm_clear'))::DOUBLE AS n_calm_clear,
                 (count(*) FILTER (WHERE year <= 1998))::DOUBLE AS n_development, avg(sd_tmin) AS mean_sd FROM nights)
    SELECT category, metric, numeric_value, CASE metric WHEN 'cool_rate_coverage_pct' THEN '%' ELSE '' END AS units
    FROM (UNPIVOT a ON n_station_nights, n_readings, n_stations, cool_rate_coverage_pct INTO NAME metric VALUE numeric_value)
    UNION ALL SELECT category, metric, numeric_value, CASE metric WHEN 'mean_sd' THEN 'C' ELSE '' END
    FROM (UNPIVOT b ON n_nights, n_calm_clear, n_development, mean_sd INTO NAME metric VALUE numeric_value)""")
def metric_register(t: Tables) -> DataFrame:
    sn, n = m.station_nights(t), m.nights(t)
    a = checks.metric_rows(sn, "panel", {
        "n_station_nights": F.count("*"), "n_readings": F.sum("n_samples"), "n_stations": F.countDistinct("station"),
        "cool_rate_coverage_pct": 100.0 * F.avg(F.col("cool_rate").isNotNull().cast("double"))},
        {"cool_rate_coverage_pct": "%"})
    b = checks.metric_rows(n, "nights", {
        "n_nights": F.count("*"), "n_calm_clear": F.count_if(F.col("regime") == "calm_clear"),
        "n_development": F.count_if(F.col("year") <= 1998), "mean_sd": F.avg("sd_tmin")}, {"mean_sd": "C"})
    return union_all(a, b)


@query("claims_in_texts", "S19", "claim:s needle:s n_texts:i found:b", """
    WITH claims AS (
      SELECT 'language_' || lang AS claim, lang AS needle FROM (SELECT DISTINCT lang FROM documents)
      UNION ALL SELECT 'source_' || source, source FROM (SELECT DISTINCT source FROM documents)
      UNION ALL SELECT 'longest_tail', printf('%.1f', max(n_chars) / 1000.0) FROM documents
      UNION ALL SELECT 'two_words', 'of the')
    SELECT claim, needle, count(d.doc_id) AS n_texts, count(d.doc_id) > 0 AS found
    FROM claims LEFT JOIN documents d ON contains(regexp_replace(d.text, '\\s+', ' ', 'g'), needle)
    GROUP BY claim, needle""")
def claims_in_texts(t: Tables) -> DataFrame:
    docs = t.documents
    claims = union_all(
        docs.select("lang").distinct().select(F.concat(F.lit("language_"), "lang").alias("claim"), F.col("lang").alias("needle")),
        docs.select("source").distinct().select(F.concat(F.lit("source_"), "source").alias("claim"), F.col("source").alias("needle")),
        docs.agg(F.format_string("%.1f", F.max("n_chars") / 1000.0).alias("needle")).select(F.lit("longest_tail").alias("claim"), "needle"),
        t.spark.range(1).select(F.lit("two_words").alias("claim"), F.lit("of the").alias("needle")),
    )
    return checks.claims_in_text(claims, docs, "text")


@query("written_and_read_back", "S8 S9", "fmt:s n:i total", c.with_(c.PANEL) + """
    SELECT fmt, count(*) AS n, sum(warmth) AS total FROM city, (VALUES ('parquet'), ('csv'), ('json'), ('cache')) f(fmt) GROUP BY 1""")
def written_and_read_back(t: Tables) -> DataFrame:
    from duskline.session import shared_folder
    from duskline.sources import writers

    folder = f"{shared_folder(t.spark)}/exports-{uuid.uuid4().hex}"
    city = m.city_nights(t).select(F.year("night_date").alias("year"), "night_date", "n_stations", "warmth")
    parts = []
    for fmt in ("parquet", "csv", "json"):
        path = writers.write(city, folder, f"city_{fmt}", fmt, partition_by=["year"] if fmt == "parquet" else ())
        back = t.spark.read.format(fmt).options(header=True).schema(city.schema).load(path)
        parts.append(back.agg(F.count("*").alias("n"), F.sum("warmth").alias("total")).select(F.lit(fmt).alias("fmt"), "n", "total"))
    again = writers.cached(city, f"{shared_folder(t.spark)}/city_cache")
    parts.append(again.agg(F.count("*").alias("n"), F.sum("warmth").alias("total")).select(F.lit("cache").alias("fmt"), "n", "total"))
    return union_all(*parts)
