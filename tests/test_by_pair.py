"""Queries over tables in buckets by pair shuffle no fact, and the tables are built from few shuffled columns."""

from pyspark.sql import functions as F

from arcweave.checks.catalog import all_queries
from arcweave.checks.q_geometry import _f1_with_line
from arcweave.operators.arcs import PAIR, with_pair
from arcweave.operators.joins import join_by_pair
from arcweave.operators import validate as V
from arcweave.plans.etl import build_network_from_raw, build_validated_network
from arcweave.plans.publish import edge_features
from arcweave.sources import files as IO
from arcweave.sources import fixtures as X
from arcweave.sources import variants as VA
from arcweave.sources.buckets import deal_by_pair

from conftest import SF_SMALL, rows


def plan_without_broadcast(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(plan):
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


def test_lines_are_joined_with_small_values(spark):
    plan = X.trade_fact_lines(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Join Inner", 1)[1]
    join = below.splitlines()[1]
    assert "returned" in join and "good" in join and "early" in join and "l_shipdate#" not in join.split("AS early")[-1]
    raw = X.trade_lines(spark, SF_SMALL).select(
        "supp_node", "cust_node", (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_partkey") % X.N_GOODS_FROM_PARTS + 1).cast("int").alias("good"),
        (F.col("l_shipdate") < F.lit(X.BASELINE_CUTOFF).cast("timestamp")).alias("early"), "l_quantity")
    made = X.trade_fact_lines(spark, SF_SMALL)
    assert raw.exceptAll(made).isEmpty() and made.exceptAll(raw).isEmpty()


def test_dealing_by_pair_shuffles_no_pair_columns(spark):
    df = spark.range(50).select(F.col("id").alias("src"), (50 - F.col("id")).alias("dst"))
    dealt = deal_by_pair(df, 4)
    assert "least(src" in exchanges(dealt._jdf.queryExecution().executedPlan().toString())[0]
    assert rows(dealt, *PAIR) == sorted((min(a, 50 - a), max(a, 50 - a)) for a in range(50))
    at = dealt.select(*PAIR, F.spark_partition_id().alias("p"), F.expr("pmod(hash(pair_lo, pair_hi), 4)").alias("b"))
    assert at.filter("p != b").isEmpty()  # the partition of a row is its bucket


def test_joins_by_pair_equal_plain_joins(spark):
    schema = "run string, src long, dst long, k int"
    a = [("r", 1, 2, 1), ("r", 2, 1, 2), ("r", 1, 2, 3), ("b", 1, 2, 4), ("r", 3, 3, 5), ("r", None, 2, 6), (None, 1, 2, 7)]
    b = [("r", 1, 2, 10), ("r", 1, 2, 11), ("b", 2, 1, 12), ("r", 3, 3, 13), ("r", 2, None, 14), (None, 1, 2, 15)]
    left = spark.createDataFrame(a, schema)
    right = spark.createDataFrame(b, schema.replace("k", "m"))
    on = ["run", "src", "dst"]
    for how in ("inner", "left"):
        want = sorted(map(repr, map(tuple, left.join(right, on, how).select(*on, "k", "m").collect())))
        got = join_by_pair(with_pair(left, "src", "dst"), with_pair(right, "src", "dst"), on, how)
        assert sorted(map(repr, map(tuple, got.select(*on, "k", "m").collect()))) == want


def test_transport_cost_exchanges_no_arcs(spark):
    X.fixture_store(spark, SF_SMALL)
    plan = plan_without_broadcast(spark, lambda: all_queries()["c22_transport_cost"].build(spark, SF_SMALL))
    assert plan.count("SortMergeJoin") == 2 and exchanges(plan) == []


def test_written_results_exchange_no_facts(spark, monkeypatch):
    X.fixture_store(spark, SF_SMALL)
    plans = []
    write = IO.write_results

    def spy(nodes, edges, *rest):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        write(nodes, edges, *rest)

    monkeypatch.setattr(IO, "write_results", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = all_queries()["a5_write_results"].build(spark, SF_SMALL).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n == X.trade_edges(spark, SF_SMALL).count()
    assert exchanges(plans[0]) == []


def test_features_are_written_compressed_and_whole(spark, tmp_path):
    features = edge_features(_f1_with_line(spark, SF_SMALL))
    IO.write_lines(features, str(tmp_path / "f"))
    IO.write_lines(features, str(tmp_path / "plain"), "none")
    sizes = [sum(p.stat().st_size for p in (tmp_path / d).glob("part-*")) for d in ("f", "plain")]
    assert sizes[0] * 4 < sizes[1]
    back = spark.read.text(str(tmp_path / "f"))
    assert rows(back, "value") == rows(features, "feature")


def test_results_are_written_compressed_and_whole(spark, tmp_path):
    nodes = X.trade_nodes(spark, SF_SMALL).select("node", "lon", "name")
    edges = X.trade_edges(spark, SF_SMALL).select("from", "to", "delta_tau", "geometry")
    for name, how in (("gz", ()), ("plain", ("none",))):
        IO.write_results(nodes, edges, str(tmp_path / name), "csv", *how)
        for table, df in (("nodes_results", nodes), ("edges_results", edges)):
            back = spark.read.option("header", True).csv(str(tmp_path / name / table))
            assert back.columns == df.columns
            assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, df.select(
                *[F.col(f"`{c}`").cast("string") for c in df.columns]).collect())))
    sizes = [sum(p.stat().st_size for p in (tmp_path / d / "edges_results").glob("part-*")) for d in ("gz", "plain")]
    assert sizes[0] * 2 < sizes[1]


def test_raw_tables_by_pair_are_joined_and_checked_where_they_lie(spark, tmp_path):
    X.fixture_store(spark, SF_SMALL)
    plan = plan_without_broadcast(
        spark, lambda: build_network_from_raw(*VA.raw_tables(spark, SF_SMALL, paired=True))[0].edges)
    assert "SortMergeJoin" in plan and exchanges(plan) == []
    got = {}
    for paired in (True, False):
        net, findings = build_validated_network(*VA.raw_tables(spark, SF_SMALL, paired=paired), str(tmp_path / str(paired)))
        cols = [c for c in net.edges.columns if c not in PAIR]  # in the same order
        got[paired] = (
            sorted(map(repr, net.edges.select(*cols).collect())), sorted(map(repr, findings.collect())))
        if paired:
            first = V.with_first_of_pair(net.edges)._jdf.queryExecution().executedPlan().toString()
            assert all(c in net.edges.columns for c in PAIR) and exchanges(first) == []
    assert got[True] == got[False]
