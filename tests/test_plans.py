"""Physical-plan properties of headline queries: pushdown, pruning, no Python in the
hot path, no multi-row cartesian products."""

import re

import pytest

from arcweave.checks.catalog import all_queries
from arcweave.checks.q_geometry import _f1_with_line
from arcweave.plans.publish import edge_features
from arcweave.plans.results import edge_table, network_cap
from arcweave.sources import fixtures as X

from conftest import SF_SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["f1_edge_table", "f2_node_table", "e14_edge_metric_catalogue",
                                  "h5_latest_progress", "d8_sweep_model_arcs"])
def test_no_python_and_no_cartesian(spark, name):
    df = all_queries()[name].build(spark, SF_SMALL)
    text = plan_text(df)
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "CartesianProduct" not in text


def test_f1_scans_are_pruned_and_filtered(spark):
    df = all_queries()["f1_edge_table"].build(spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet [^\n]*", text)
    assert scans, text
    # the allocation scans read only the run they need
    assert any("EqualTo(run_id,result)" in s for s in scans)
    # no scan reads the geometry text, which F1 does not need
    assert not any("geometry" in s.split("ReadSchema:")[-1] for s in scans)


def test_f1_over_buckets_needs_no_exchange(spark):
    net = X.trade_network(spark, SF_SMALL, paired=True)
    alloc = X.trade_allocations(spark, SF_SMALL, net, paired=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(edge_table(net, alloc.arc_infra, alloc.arc_flow, "result", 5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 2
    assert [x for x in plan.splitlines() if "Exchange hashpartitioning" in x] == []
    # edges are read once for the rows and once, one column, for the cap
    assert plan.count("FileScan parquet") == 4 and "geometry" not in "".join(re.findall(r"ReadSchema: [^\n]*", plan))


def test_f1_cap_joins_only_unbounded_networks(spark):
    net = X.trade_network(spark, SF_SMALL)
    alloc = X.trade_allocations(spark, SF_SMALL, net)
    free = X.NetworkTables(net.nodes, net.edges.drop("Iu"))
    cap = network_cap(free.edges, alloc.arc_infra.filter("run_id = 'result'"))
    assert "Join" in cap._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in network_cap(net.edges, alloc.arc_infra)._jdf.queryExecution().optimizedPlan().toString()
    new = edge_table(free, alloc.arc_infra, run_id="result").agg({"Ijk": "max", "Ijk_orig": "max"}).first()
    assert cap.first()["cap"] == max(new)


def test_features_parse_once_and_exchange_no_edges(spark):
    """Lines are found where the edges are stored by pair, and their text is not parsed again inside the rounding."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = edge_features(_f1_with_line(spark, SF_SMALL))
        tree, plan = df._jdf.queryExecution().optimizedPlan().toString(), plan_text(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = next(x for x in tree.splitlines() if "StructsToJson" in x)
    assert "transform(" in text and "regexp_extract" not in text
    assert sum("regexp_extract_all" in x for x in tree.splitlines()) == 1
    # only nodes, pairs and coordinates are dealt by node, and pairs come back: no text, line or result column
    dealt = [i for i, x in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in x]
    assert len(dealt) == 5
    assert all("geometry" not in x and "line" not in x for x in plan.splitlines() if "Exchange" in x)
