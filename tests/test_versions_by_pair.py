"""Versions of the edge table lie in buckets by pair, so that only the new edges are shuffled."""

import pytest
from pyspark.sql import functions as F

from arcweave.operators.arcs import PAIR
from arcweave.plans import incremental as I
from arcweave.plans.results import edge_base
from arcweave.sources.buckets import deal_by_pair

EDGE = "from long, to long, delta_i double, delta_tau double, Ijk double, Iu double"
INFRA = "run_id string, src long, dst long, ijk double"


def edges(spark, n, add=0.0):
    return spark.createDataFrame([(i, 2 * i + 1, 1.0, 0.5, i + (add if i % 5 == 0 else 0.0), 90.0) for i in range(1, n)]
                                 + [(None, None, 1.0, 1.0, 1.0, 1.0)], EDGE)


def infra(spark):
    return spark.createDataFrame([("r", *way, 7.0 * i) for i in range(1, 60) for way in ((i, 2 * i + 1), (2 * i + 1, i))], INFRA)


@pytest.fixture
def sorted_joins(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_second_version_deals_the_new_edges_once(spark, tmp_path, sorted_joins):
    path = str(tmp_path / "sink")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert I.publish_edges(edges(spark, 40), infra(spark), None, path, 1, buckets=n)
    before = I._facts_by_pair(spark, path, 1, n)
    again = spark.read.parquet(write(edges(spark, 50, 3.0), str(tmp_path / "up")))
    base = edge_base(again)
    after = deal_by_pair(base.filter("pair_lo is not null and pair_hi is not null").drop(*PAIR), n, "from", "to")
    found = I.with_changes(before, after, [c for c in base.columns if c not in PAIR])
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("ReusedExchange" in x for x in plan) == 1
    plan = [x for x in plan if "ReusedExchange" not in x]
    assert sum("REPARTITION_BY_NUM" in x for x in plan) == 1
    # besides, only the changed pairs are dealt: the version before is read in its buckets
    assert sum("Exchange hashpartitioning" in x and "REPARTITION" not in x for x in plan) <= 1
    changed = {i for i in range(1, 50) if i % 5 == 0 or i >= 40}
    assert {r["from"] for r in found.collect()} == changed and found.filter("_here is null").isEmpty()


def write(df, path):
    df.write.parquet(path)
    return path


def test_a_bucket_is_one_file_and_a_replay_needs_no_catalogue(spark, tmp_path):
    path = str(tmp_path / "sink")
    touched = I.publish_edges(edges(spark, 40), infra(spark), None, path, 1, buckets=4)
    rows = spark.read.parquet(f"{path}/facts/at=1")
    assert rows.filter(F.col("bucket") != F.expr("pmod(hash(pair_lo, pair_hi), 4)")).isEmpty()
    assert len(touched) == rows.select("bucket").distinct().count() == rows.select(F.input_file_name()).distinct().count()
    want = sorted(map(tuple, I.read_edges_version(spark, path).collect()))
    spark.sql(f"DROP TABLE {I._table(path, 1)}")  # as in another session; the files stay
    assert I.publish_edges(edges(spark, 40), infra(spark), None, path, 1, buckets=4) == touched
    assert sorted(map(tuple, I.read_edges_version(spark, path).collect())) == want
    spark.sql(f"DROP TABLE {I._table(path, 1)}")
    assert I.publish_edges(edges(spark, 40).filter("from != 3"), infra(spark), None, path, 2, buckets=4)
    assert I.read_edges_version(spark, path).count() == len(want) - 1
