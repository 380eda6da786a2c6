"""Exact sums, and every row with every parameter row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arcweave.functions.sums import exact_sums
from arcweave.operators import aggregates as A
from arcweave.operators.util import attach_rows


def values(seed, n=3000):
    rng = random.Random(seed)
    out = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 13) for _ in range(n)]
    out += [-x for x in out[:n // 3]]  # much cancels
    out += [0.0, -0.0, 2.0 ** 64, 2.0 ** -64, 3e-320, 5e-324, 1.7e300, -1.7e300, 0.1, math.nextafter(2.0 ** 32, 0)]
    out += [2.0 ** k for k in range(-70, 70, 7)] + [math.nextafter(2.0 ** k, 0) for k in range(-64, 65, 32)]
    rng.shuffle(out)
    return out


def test_sums_have_the_same_bits_for_any_partitioning(spark):
    for seed in (1, 2, 3):
        xs = values(seed)
        rows = [(i % 4, x) for i, x in enumerate(xs)] + [(9, None), (1, None)]
        df = spark.createDataFrame(rows, "k int, x double")
        results = set()
        for parts in (1, 7, 200):
            got = exact_sums(df.repartition(parts), {"s": F.col("x"), "t": F.col("x") * 2}, ("k",)).collect()
            results.add(tuple(sorted((r.k, None if r.s is None else r.s.hex(), None if r.t is None else r.t.hex())
                                     for r in got)))
        assert len(results) == 1
        for k, s, t in results.pop():
            if k == 9:
                assert s is None and t is None
                continue
            want = math.fsum(x for kk, x in rows if kk == k and x is not None)
            assert abs(float.fromhex(s) - want) <= 2 * math.ulp(want)
            assert abs(float.fromhex(t) - 2 * want) <= 2 * math.ulp(2 * want)


def test_odd_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 1.0), (2, float("inf")), (2, 5.0), (3, float("inf")),
                                (3, float("-inf")), (4, 2.0)], "k int, x double")
    got = {r.k: r.s for r in exact_sums(df, {"s": F.col("x")}, ("k",)).collect()}
    assert math.isnan(got[1]) and got[2] == math.inf and math.isnan(got[3]) and got[4] == 2.0
    assert exact_sums(df.limit(0), {"s": F.col("x")}).collect()[0].s is None
    assert exact_sums(df.limit(0), {"s": F.col("x")}, ("k",)).collect() == []


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_rescaling_by_the_exact_cost_is_the_identity(spark, parts):
    rng = random.Random(4)
    rows = [(i, rng.uniform(0.1, 9), rng.uniform(1, 1e6)) for i in range(2000)]
    arcs = spark.createDataFrame(rows, "id int, delta_i double, ijk double")
    K = A.budget_spent(arcs.repartition(parts)).select(F.col("spent").alias("K"))
    out = A.rescale_to_budget(arcs.repartition(3), K)
    assert sorted(map(tuple, out.select("id", "ijk").collect())) == [(i, x) for i, _, x in rows]


def test_every_row_meets_every_parameter(spark):
    df = spark.range(101).withColumnRenamed("id", "a")
    params = spark.range(37).selectExpr("id as p", "cast(null as string) q")
    want = sorted((a, p, None) for a in range(101) for p in range(37))
    for limit, tasks in ((100, None), (36, 8), (10, 8), (10, 1), (1, 50)):
        out = attach_rows(df, params, limit, tasks)
        assert out.columns == ["a", "p", "q"] and sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert attach_rows(df, params.limit(0)).count() == 0


def test_small_parameter_tables_copy_no_row(spark):
    df, params = spark.range(1000), spark.range(3).withColumnRenamed("id", "p")
    plan = attach_rows(df, params)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("Generate") == 1 and "Generate inline" in plan
    wide = attach_rows(df, params, 2, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in wide and "CartesianProduct" not in wide and "NestedLoop" not in wide
