"""Scalar functions on hand-worked values."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidemeter.functions import calendar as K
from tidemeter.functions import columns as C
from tidemeter.functions import special as S
from tidemeter.operators import curves as V


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    "field, code, name, lenient",
    [
        ("(02202)Calle 127 - L Oreal Paris", "02202", "Calle 127 - L Oreal Paris", "02202"),
        ("(09104) Restrepo (Sur)", "09104", "Restrepo (Sur", "09104"),
        ("(09104 Restrepo", None, None, "09104 Restrepo"),
        ("no code", None, None, None),
        (None, None, None, None),
    ],
)
def test_station_field(spark, field, code, name, lenient):
    f = F.lit(field).cast("string")
    row = one(spark, C.station_code(f), C.station_name(f), C.station_code_lenient(f))
    assert tuple(row) == (code, name, lenient)


def test_clock(spark):
    ts = F.to_timestamp(F.lit("2025-10-14 06:16:00"))
    row = one(
        spark, C.hhmm(ts), C.minute_of_day(ts), C.hhmm_to_minutes(F.lit(616)), C.minutes_to_hhmm(F.lit(376)),
        C.floor_minutes(ts, 15).cast("string"), C.ceil_minutes(ts, 5).cast("string"),
        C.ceil_minutes(C.floor_minutes(ts, 15), 5).cast("string"),
    )
    assert tuple(row) == (616, 376, 376, 616, "2025-10-14 06:15:00", "2025-10-14 06:20:00", "2025-10-14 06:15:00")


def test_week_of_month_and_day_type(spark):
    rows = spark.createDataFrame([("2025-10-14",), ("2025-06-30",)], "d string").select(C.week_of_month(F.to_date("d")))
    assert [r[0] for r in rows.collect()] == [3, 6]
    days = spark.createDataFrame([(f"2024-01-0{i}",) for i in (1, 6, 7, 8, 9)], "d string").select(F.to_date("d").alias("d"))
    assert [r["date_type"] for r in K.with_day_type(days, "d").orderBy("d").collect()] == ["HO", "SA", "SU", "HO", "WD"]


def test_holidays_of_2025(spark):
    found = {str(r["date"]): r["holiday"] for r in K.holidays_between(spark, 2025, 2025).collect()}
    assert len(found) == 17
    assert found["2025-01-06"] == "Día de los Reyes Magos"
    assert found["2025-04-18"] == "Viernes Santo"
    assert found["2025-06-30"] == "Día de San Pedro y San Pablo; Sagrado Corazón de Jesús"
    assert "2025-10-14" not in found


def test_special_functions(spark):
    xs = [-6.0, -2.5, -0.47, -0.2, 0.0, 0.46, 0.5, 1.7, 3.9, 4.1, 7.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.erfc(F.col("x"))).collect()]
    assert all(math.isclose(a, math.erfc(x), rel_tol=1e-12) for a, x in zip(got, xs))
    ps = [1e-12, 1e-4, 0.05, 0.3, 0.5, 0.93, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(S.normal_ppf(F.col("p"))).collect()]
    assert all(math.isclose(a, statistics.NormalDist().inv_cdf(p), rel_tol=1e-9, abs_tol=1e-12) for a, p in zip(got, ps))
    ls = [0.001, 0.5, 1.0, 3.5, 100.25, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ls], "x double").select(S.lgamma(F.col("x"))).collect()]
    assert all(math.isclose(a, math.lgamma(x), rel_tol=1e-10, abs_tol=1e-10) for a, x in zip(got, ls))


def test_tail_probabilities(spark):
    chi = spark.createDataFrame([(9.487729, 4), (3.841459, 1), (19.67514, 11)], "x double, k int")
    assert all(abs(r[0] - 0.05) < 1e-6 for r in chi.select(S.chi2_sf(F.col("x"), F.col("k"))).collect())
    f = spark.createDataFrame([(4.102821, 2.0, 10.0)], "f double, a double, b double").select(S.f_sf("f", "a", "b")).first()[0]
    assert abs(f - 0.05) < 1e-6
    # critical values of the exact Kolmogorov distribution at 5 percent
    ks = spark.createDataFrame([(10.0, 0.40925), (20.0, 0.29408), (100.0, 0.13403)], "n double, d double")
    assert all(abs(r[0] - 0.05) < 5e-4 for r in ks.select(S.ks_sf("n", "d")).collect())


def test_curve_functions(spark):
    arr = lambda *v: F.array(*[F.lit(x).cast("double") for x in v])
    assert one(spark, V.resample(arr(0, 1, 2), 5))[0] == [0, 0.5, 1, 1.5, 2]
    assert one(spark, V.fill_gaps(arr(None, 1, None, None, 4, None)))[0] == [1, 1, 2, 3, 4, 4]
    assert one(spark, V.normalise(arr(1, 3)))[0] == [0.25, 0.75]
    assert one(spark, V.normalise(arr(0, 0)))[0] == [0, 0]
    assert V.expected_points(400, 700) == 13


def test_hash_is_stable_under_repartition(spark):
    a = spark.range(100).select("id", C.unit_hash("id").alias("u")).orderBy("id").collect()
    b = spark.range(100).repartition(7).select("id", C.unit_hash("id").alias("u")).orderBy("id").collect()
    assert a == b and all(0 <= r["u"] < 1 for r in a)


def test_ks_p_values_agree_across_the_exact_limit(spark):
    points = [(n, z / n**0.5) for n in (2001.0, 2500.0) for z in (0.45, 0.6, 0.8, 1.0, 1.3, 1.7)]
    got = spark.createDataFrame(points, "n double, d double").select("n", "d", S.ks_sf("n", "d").alias("p")).collect()
    assert all(abs(r.p - (1 - S.kolmogorov_exact_cdf(int(r.n), r.d))) < 1e-7 for r in got)
