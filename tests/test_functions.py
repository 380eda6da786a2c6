"""Golden rows for the scalar column functions (section 2C)."""

import math

import pytest
from pyspark.sql import functions as F

from arcweave.functions import (iceberg_cost, increase, normalise, parse_linestring, pct_gain,
                                perc_upgraded, parse_progress, round_sig, to_linestring,
                                transform_value, utility, widen_domain, haversine_km)


def one(spark, expr, schema="x double", value=None):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("text,expected", [
    ("LINESTRING (9.5 1.8, 10.1 2.2)", [(9.5, 1.8), (10.1, 2.2)]),
    ("linestring(1 2 3,4 5)", [(1.0, 2.0), (4.0, 5.0)]),
    ("  LINESTRING ( 1   2 , 3 4 )  ", [(1.0, 2.0), (3.0, 4.0)]),
    ("POINT (1 2)", None),
    ("LINESTRING (1 2)", None),
    ("LINESTRING (1 x, 2 3)", None),
    ("LINESTRING ()", None),
    (None, None),
])
def test_parse_linestring(spark, text, expected):
    got = one(spark, parse_linestring(F.col("x")), "x string", text)
    assert (None if got is None else [(p.lon, p.lat) for p in got]) == expected


def test_linestring_round_trip(spark):
    txt = "LINESTRING (9.5 1.8, -0.0009 2.25, 10.0 2.2)"
    assert one(spark, to_linestring(parse_linestring(F.col("x"))), "x string", txt) == txt


def test_iceberg_cost(spark):
    assert one(spark, iceberg_cost(F.col("x"), 0.005), value=0.0) == 0.005
    assert one(spark, iceberg_cost(F.col("x"), 0.0), value=1.0) == 0.0
    assert one(spark, iceberg_cost(F.col("x"), 0.0), value=-1.0) is None
    v = one(spark, iceberg_cost(F.col("x"), 0.0), value=100.0)
    assert v == pytest.approx(0.1158826 * math.log(100 / 1.609))


def test_haversine_quarter_meridian(spark):
    df = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("v"))
    assert df.first()["v"] == pytest.approx(6371.0 * math.pi / 2)


@pytest.mark.parametrize("x,k,expected", [
    (0.0, 7, 0.0), (123456789.0, 7, 123456800.0), (-0.000123456789, 4, -0.0001235),
    (1e-7, 7, 1e-7), (1e15, 7, 1e15), (2.5, 1, 2.0), (3.5, 1, 4.0), (float("nan"), 7, None),
    (None, 7, None),
])
def test_round_sig(spark, x, k, expected):
    got = one(spark, round_sig(F.col("x"), k), value=x)
    assert got == (pytest.approx(expected) if expected is not None else None)


@pytest.mark.parametrize("new,old,iu,cap,expected", [
    (60.0, 40.0, 100.0, 500.0, 100.0 / 3), (40.0, 40.0, None, 80.0, 0.0),
    (90.0, 40.0, 40.0, 80.0, 100.0), (40.0, 40.0, 40.0, 80.0, 0.0),
    (200.0, 40.0, 100.0, 80.0, 100.0), (30.0, 40.0, 100.0, 80.0, 0.0),
])
def test_perc_upgraded(spark, new, old, iu, cap, expected):
    df = spark.createDataFrame([(new, old, iu, cap)], "n double, o double, iu double, c double")
    got = df.select(perc_upgraded("n", "o", "iu", "c").alias("v")).first()["v"]
    assert got == pytest.approx(expected)


def test_pct_gain_and_increase(spark):
    df = spark.createDataFrame([(-2.0, -4.0), (1.0, 0.0), (3.0, 5.0)], "n double, o double")
    out = df.select(pct_gain("n", "o").alias("g"), increase("n", "o").alias("i")).collect()
    assert out[0]["g"] == pytest.approx(50.0)  # negative baselines: divide by |old|
    assert out[1]["g"] is None
    assert [r["i"] for r in out] == [2.0, 1.0, 0.0]


def test_transforms_domain_guards(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (8.0,)], "x double")
    got = {t: [r["v"] for r in df.select(transform_value("x", t).alias("v")).collect()]
           for t in ("log", "log10", "log1p", "sqrt", "cbrt")}
    assert got["log"][:2] == [None, None]
    assert got["log1p"][0] is None
    assert got["sqrt"][0] is None and got["sqrt"][2] == pytest.approx(math.sqrt(8))
    assert got["cbrt"][0] == pytest.approx(-1.0) and got["cbrt"][2] == pytest.approx(2.0)


def test_normalise_clamps_and_widens(spark):
    df = spark.createDataFrame([(5.0, 5.0, 5.0), (-1.0, 0.0, 10.0), (20.0, 0.0, 10.0)],
                               "x double, lo double, hi double")
    out = [r["v"] for r in df.select(
        normalise("x", "lo", widen_domain("lo", "hi")).alias("v")).collect()]
    assert out == [0.0, 0.0, 1.0]


def test_utility(spark):
    df = spark.createDataFrame([(4.0, 1.0, 0.5, 0.0), (4.0, 1.0, 0.5, 1.0), (4.0, 1.0, 0.5, 2.0)],
                               "c double, h double, a double, r double")
    out = [r["u"] for r in df.select(utility("c", "h", "a", "r").alias("u")).collect()]
    assert out[0] == pytest.approx(2.0) and out[1] is None and out[2] == pytest.approx(-0.5)


def test_parse_progress(spark):
    df = spark.createDataFrame(
        [("Iteration No. 12 distance=3.5e-3 duration=1.0 secs. Welfare=1",), ("hello",)], "line string")
    out = df.select(parse_progress("line").alias("p")).collect()
    assert (out[0]["p"]["iteration"], out[0]["p"]["distance"]) == (12, 0.0035)
    assert out[1]["p"]["iteration"] is None and out[1]["p"]["distance"] is None
