"""Readers, writers, checks and the query registry."""

from __future__ import annotations

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from duskline.operators import joins
from duskline.plans.catalog import REGISTRY
from duskline.sources import checks, readers, writers
from duskline.sources.tables import TABLES

SF = "/root/testdata/sf0.01"


def test_csv_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_bytes("﻿id,east\nA,2683000.5\nB,\n".encode())
    r = readers.read_csv(spark, str(p), "id string, east double", ["id", "east"]).orderBy("id").collect()
    assert [(x.id, x.east) for x in r] == [("A", 2683000.5), ("B", None)]


def test_json_parallel_arrays(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"lat": 1.0, "hourly": {"time": ["2020-06-01T00:00", "2020-06-01T01:00"], "cc": [1.0, None]}}, indent=1))
    d = readers.read_json_documents(spark, str(p), "lat double, hourly struct<time:array<string>, cc:array<double>>")
    r = readers.explode_parallel_arrays(d.select("lat", "hourly.*"), ["time", "cc"], ["lat"]).orderBy("time").collect()
    assert [(x.time, x.cc) for x in r] == [("2020-06-01T00:00", 1.0), ("2020-06-01T01:00", None)]


def test_write_formats_and_cache(spark, frame, tmp_path):
    df = frame("y long, v double", [(2001, 1.5), (2002, 2.5)])
    for fmt in ("parquet", "csv", "json"):
        path = writers.write(df, str(tmp_path), f"o_{fmt}", fmt, ["y"] if fmt == "parquet" else ())
        back = spark.read.format(fmt).options(header=True).schema(df.schema).load(path)
        assert sorted(map(tuple, back.select("y", "v").collect())) == [(2001, 1.5), (2002, 2.5)]
    first = writers.cached(df, str(tmp_path / "c"))
    again, other = writers.cached(df, str(tmp_path / "c")), writers.cached(df.withColumn("v", F.col("v") * 0), str(tmp_path / "c"))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) and first.inputFiles() == again.inputFiles()
    assert {r["v"] for r in other.collect()} == {0.0}
    df.write.parquet(str(tmp_path / "p"))
    one = writers.cached(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "c")).count()
    df.union(df).write.mode("overwrite").parquet(str(tmp_path / "p"))
    assert (one, writers.cached(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "c")).count()) == (2, 4)


def test_cache_never_reads_a_write_that_failed(spark, frame, tmp_path):
    """A half-written folder of an earlier run, and one whose mark was not committed, are not results."""
    df = frame("y long, v double", [(i, float(i)) for i in range(100)])
    base = tmp_path / "c" / writers._input_key(df)
    failing = df.withColumn("v", F.when(F.col("y") < 99, F.col("v")).otherwise(F.raise_error(F.lit("stop")).cast("double"))).repartition(4, "y")
    with pytest.raises(Exception, match="stop"):
        failing.write.parquet(str(base / "run-0"))
    (base / "run-0").mkdir(parents=True, exist_ok=True)
    (base / "mark-run-0" / "_temporary").mkdir(parents=True)
    assert writers.cached(df, str(tmp_path / "c")).count() == 100
    assert writers.cached(df, str(tmp_path / "c")).count() == 100 and len(list(base.glob("run-*"))) == 2


def test_cache_with_two_writers(spark, frame, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    df = frame("y long, v double", [(i, float(i)) for i in range(50)])
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda _: writers.cached(df, str(tmp_path / "c")).count(), range(2)))
    assert got == [50, 50]
    assert len({writers.cached(df, str(tmp_path / "c")).inputFiles()[0].rsplit("/", 1)[0] for _ in range(2)}) == 1


def test_file_digests_and_manifest(spark, tmp_path):
    import hashlib

    rng = __import__("random").Random(1)
    bodies = {"a.bin": bytes(rng.randrange(256) for _ in range(300_000)), "b.bin": b"\n\n", "sub/c.bin": b"no end", "d.bin": b"end\n", "e.bin": b"\r\nx\r", "f.bin": b"\n" * 5000 + b"z"}
    for name, body in bodies.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits a file
    try:
        got = {r.path.rsplit("/t/", 1)[1]: r for r in checks.file_digests(spark, str(tmp_path / "t")).collect()}
        assert {k: v.sha256 for k, v in got.items()} == {k: hashlib.sha256(b).hexdigest() for k, b in bodies.items()}
        assert all(got[k].size == len(b) for k, b in bodies.items())
        manifest = spark.createDataFrame([("a.bin", got["a.bin"].sha256), ("b.bin", "other"), ("sub/c.bin", got["sub/c.bin"].sha256), ("gone", "x")], "file string, expected string")
        found = {r.file: r.status for r in checks.verify_files(spark, str(tmp_path / "t"), manifest).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {"a.bin": "ok", "b.bin": "altered", "sub/c.bin": "ok", "gone": "missing", "d.bin": "unexpected", "e.bin": "unexpected", "f.bin": "unexpected"}


def test_checks_report_every_failure(frame):
    df = frame("k long, v double", [(1, 1.0), (1, float("nan")), (2, None)])
    with pytest.raises(checks.CheckFailed, match="missing"):
        checks.require_columns(df, ["k", "z"])
    with pytest.raises(checks.CheckFailed, match="duplicate"):
        checks.assert_unique(df, "k")
    assert checks.not_finite(df, ["v"]).first().n_bad == 2
    r = {x.rule: x.ok for x in checks.check_invariants(df, {"n": (F.count("*"), F.col("observed") == 3), "u": (F.countDistinct("k"), F.col("observed") == 3)}).collect()}
    assert r == {"n": True, "u": False}
    with pytest.raises(checks.CheckFailed):
        checks.checked_join(df, df, "k")


def test_claims_fold_white_space(frame):
    docs = frame("t string", [("a  value\nof 0.25 here",), ("nothing",)])
    r = {x.claim: x.found for x in checks.claims_in_text(frame("claim string, needle string", [("x", "value of 0.25"), ("y", "absent")]), docs, "t").collect()}
    assert r == {"x": True, "y": False}


def test_distinct_on_and_factor_levels(frame):
    df = frame("k long, o long", [(1, 2), (1, 1), (2, 5)])
    assert sorted((r.k, r.o) for r in readers.distinct_on(df, ["k"], ["o"]).collect()) == [(1, 1), (2, 5)]
    assert joins.factor_levels(df, a=("x", "y"), b=(1, 2, 3)).count() == 18


SAMPLE = [
    "city_night_dispersion", "station_night_panel", "night_weather_regime", "dusk_dispersion", "partial_spearman_by_regime", "stratified_shift_test",
    "hac_slope_by_regime", "holdout_hypotheses", "calendar_block_bootstrap", "stationary_bootstrap", "kaplan_meier_median", "nearest_station",
    "inverse_distance_field", "two_way_effects", "decision_table", "interpolated_grid", "reading_percentiles", "declared_invariants",
]


@pytest.mark.parametrize("name", sorted(REGISTRY) if os.environ.get("DUSKLINE_ALL_TWINS") else SAMPLE)
def test_query_equals_its_sql_twin(spark, name):
    q = REGISTRY[name]
    rows = [tuple(r) for r in q.run(spark, SF).collect()]
    if q.oracle() is None:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    key = lambda r: tuple((v is None, 0 if v is None else v) for v in r)
    assert sorted(rows, key=key) == sorted(con.execute(q.oracle()).fetchall(), key=key)
