"""Scalar functions: night labels, snapping, sun, tails, draws."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskline.functions import coords, counter, numeric, solar
from duskline.functions import timeparts as tp
from duskline.operators import aggregates, association


def ts(*a):
    return dt.datetime(*a)


def test_night_label_boundaries(frame):
    rows = [(ts(2023, 6, 10, h, m),) for h, m in ((19, 59), (20, 0), (23, 59), (0, 0), (7, 59), (8, 0))]
    out = frame("t timestamp_ntz", rows).select(
        tp.night_date("t", 20).alias("n"), tp.in_hours("t", 20, 8).alias("inside"), tp.in_hours("t", 20, 8, closed=True).alias("closed")).collect()
    d9, d10 = dt.date(2023, 6, 9), dt.date(2023, 6, 10)
    assert [r.n for r in out] == [d9, d10, d10, d9, d9, d9]
    assert [r.inside for r in out] == [False, True, True, True, True, False]
    assert [r.closed for r in out] == [False, True, True, True, True, True]


def test_local_time_across_clock_changes(frame):
    rows = [(ts(2023, 3, 26, 0, 59),), (ts(2023, 3, 26, 1, 0),), (ts(2023, 10, 29, 0, 30),), (ts(2023, 10, 29, 1, 30),)]
    out = [r[0] for r in frame("t timestamp_ntz", rows).select(tp.to_local("t", "Europe/Berlin")).collect()]
    assert out == [ts(2023, 3, 26, 1, 59), ts(2023, 3, 26, 3, 0), ts(2023, 10, 29, 2, 30), ts(2023, 10, 29, 2, 30)]


def test_snap_is_half_even(frame):
    out = [r[0] for r in frame("x double", [(0.125,), (0.375,), (0.625,), (-0.125,)]).select(tp.snap("x")).collect()]
    assert out == [0.0, 0.5, 0.5, 0.0]


def test_midpoint_and_ceil_hour(frame):
    r = frame("t timestamp_ntz", [(ts(2023, 6, 1, 10, 0),), (ts(2023, 6, 1, 10, 15),)]).select(
        tp.midpoint("t").alias("m"), tp.ceil_hour("t").alias("c")).collect()
    assert r[0].m == ts(2023, 6, 1, 9, 52, 30) and r[0].c == ts(2023, 6, 1, 10, 0) and r[1].c == ts(2023, 6, 1, 11, 0)


def test_sunset_is_plausible(frame):
    d = frame("d date", [(dt.date(2023, 6, 21),), (dt.date(2023, 12, 21),)])
    r = d.select(solar.sunset_utc_hours("d", 50.0, 10.0).alias("h"), solar.night_length_hours("d", 50.0, 10.0).alias("n")).collect()
    assert 19.3 < r[0].h < 19.8 and 15.1 < r[1].h < 15.6
    assert r[0].n < 8.2 and r[1].n > 15.6


def test_polar_day_is_clipped_not_nan(frame):
    r = frame("d date", [(dt.date(2023, 6, 21),)]).select(solar.sunset_utc_hours("d", 80.0, 10.0).alias("h")).first()
    assert math.isfinite(r.h)


def test_normal_tail_matches_erfc(frame):
    zs = [0.0, 0.5, 1.96, -3.0, 6.5, 7.5, 12.0]
    got = [r[0] for r in frame("z double", [(z,) for z in zs]).select(numeric.normal_two_sided_p("z")).collect()]
    assert np.allclose(got, [math.erfc(abs(z) / math.sqrt(2)) for z in zs], rtol=1e-7)


def test_student_tail(frame):
    # closed forms exist for 1, 2 and 4 degrees of freedom; large df approaches the normal
    def four(t):
        q = 1 + t * t / 4
        return 1 - 0.75 * t / math.sqrt(q) * (1 - t * t / (12 * q))

    rows = [(3.0, 1.0, 1 - 2 / math.pi * math.atan(3.0)), (3.0, 2.0, 1 - 3 / math.sqrt(11)), (0.4, 2.0, 1 - 0.4 / math.sqrt(2.16)),
            (2.5, 4.0, four(2.5)), (1.96, 1e7, math.erfc(1.96 / math.sqrt(2)))]
    got = [r[0] for r in frame("t double, df double, p double", rows).select(numeric.student_two_sided_p("t", "df")).collect()]
    assert np.allclose(got, [r[2] for r in rows], rtol=1e-5)


def test_counter_draw_is_md5(frame):
    r = frame("k long", [(1,)]).select(counter.draw_int("a", "k").alias("i")).first()
    assert r.i == int(hashlib.md5(b"a_1").hexdigest()[:7], 16)


def test_lenient_cast_and_clip(frame):
    r = frame("s string", [("1.5",), ("x",), ("NaN",), (None,)]).select(numeric.try_double("s").alias("v")).collect()
    assert [x.v for x in r] == [1.5, None, None, None]
    r = frame("v double", [(5.0,), (None,)]).select(numeric.clip("v", 0, 3).alias("c")).collect()
    assert [x.c for x in r] == [3.0, None]


def test_coordinate_repair(frame):
    df = frame("e double, n double, lat double, lon double", [(2_683_000.0, 1_247_000.0, 47.37, 8.54), (268_300_000.0, 124_700_000.0, 47.37, 8.54)])
    r = coords.repair_coords(df, "e", "n", "lat", "lon", (2_650_000, 2_715_000, 1_215_000, 1_280_000)).collect()
    assert [x.coordinate_source for x in r] == ["provided", "wgs84_repair"]
    assert abs(r[1].east_repaired - 2_683_000) < 1500 and abs(r[1].north_repaired - 1_247_000) < 1500


@pytest.mark.parametrize("est,ref,p,pred,want", [
    (0.3, 0.4, 0.01, "direction", "held_significant"), (0.3, 0.4, 0.2, "direction", "held"),
    (-0.3, 0.4, 0.01, "direction", "reversed"), (0.1, 0.0, 0.2, "null", "null_kept"),
    (0.1, 0.0, 0.01, "null", "null_rejected")])
def test_verdicts(frame, est, ref, p, pred, want):
    df = frame("e double, r double, p double, k string", [(est, ref, p, pred)])
    assert df.select(association.verdict("e", "r", "p", "k")).first()[0] == want


def test_zero_variance_correlation_is_null(frame):
    df = frame("x double, y double", [(1.0, 2.0), (1.0, 3.0)])
    assert df.agg(aggregates.guarded_corr("x", "y")).first()[0] is None


def test_near(frame):
    r = frame("x double", [(21.875,), (21.86,)]).select(numeric.near("x", 22.0).alias("k")).collect()
    assert [x.k for x in r] == [True, False]
    assert frame("x double", [(1.0,)]).select(F.lit(1)).count() == 1
