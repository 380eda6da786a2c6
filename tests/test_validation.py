"""Validation rules and connected components on hand-made networks (section 2B)."""

import itertools

import pytest
from pyspark.sql import functions as F

from arcweave.operators import validate as V
from arcweave.operators.arcs import with_pair
from arcweave.operators.graph import connected_components
from arcweave.plans.validation import validate_network
from arcweave.sources.fixtures import NetworkTables, trade_network
from arcweave.sources.grid import grid_network

from conftest import SF_SMALL

NODES = [(i, 10.0 + i, 2.0, 100.0, 1.0) for i in range(1, 6)]
NODE_SCHEMA = "node long, lon double, lat double, population double, productivity double"
EDGE_SCHEMA = ("edge_id long, from long, to long, delta_i double, delta_tau double, Ijk double, "
               "Il double, Iu double")


def net(spark, edges, nodes=NODES):
    return NetworkTables(spark.createDataFrame(nodes, NODE_SCHEMA),
                         spark.createDataFrame(edges, EDGE_SCHEMA))


def rules(findings):
    return sorted((r["severity"], r["rule"], r["key"]) for r in findings.collect())


def test_missing_columns_rejected(spark):
    raw = spark.createDataFrame([("1", "2")], "node string, lon string")
    f = V.require_columns(raw, V.NODE_REQUIRED, "nodes").collect()
    assert len(f) == 1 and "lat, population, productivity" in f[0]["message"]


def test_endpoint_outside_nodes(spark):
    n = net(spark, [(1, 1, 2, 1.0, 0.1, 10.0, None, None), (2, 2, 999, 1.0, 0.1, 10.0, None, None)])
    assert ("error", "B10", 2) in rules(validate_network(n))


def test_self_loop_duplicates_and_bounds(spark):
    edges = [(1, 1, 2, 1.0, 0.1, 10.0, None, None), (2, 2, 1, 1.0, 0.1, 10.0, None, None),
             (3, 3, 3, 1.0, 0.1, 10.0, None, None), (4, 3, 4, 1.0, 0.1, 10.0, 12.0, 8.0),
             (5, 1, 2, 1.0, 0.1, 10.0, None, None)]
    got = rules(validate_network(net(spark, edges)))
    assert ("error", "B11", 3) in got
    assert ("error", "B12", 2) in got and ("error", "B12", 5) in got
    assert ("error", "B12", 1) not in got
    assert got.count(("warning", "B13", 4)) == 2


def test_coercion_accepts_integral_floats(spark):
    raw = spark.createDataFrame([("1.0", "3.0"), ("2", "3.7"), ("x", "")],
                                "node string, product string")
    typed, f = V.coerce_table(raw, "nodes", ["node"], [], optional_int=["product"])
    assert [r["node"] for r in typed.collect()] == [1, 2, None]
    msgs = sorted(r["message"] for r in f.collect())
    assert msgs == ["node holds something else than whole numbers (1 rows)",
                    "product holds something else than whole numbers (1 rows)"]


def test_numbers_are_read_exactly(spark):
    raw = spark.createDataFrame([("9007199254740993", "5d"), ("1.5f", "1.5f"), (" 3.0 ", "1e3"), ("-7", "-Inf"),
                                 ("99999999999999999999", ".5")], "node string, x string")
    typed, _ = V.coerce_table(raw, "nodes", ["node"], ["x"])
    rows = typed.collect()
    assert [r.node for r in rows] == [9007199254740993, None, 3, -7, None]
    assert [r.x for r in rows] == [None, None, 1000.0, float("-inf"), 0.5]


def test_half_networks_are_not_valid_and_stages_stop(spark):
    n = net(spark, [(1, 1, 2, 1.0, 0.1, 10.0, None, None)])
    for half in (NetworkTables(n.nodes, None), NetworkTables(None, n.edges)):
        assert not V.findings_summary(validate_network(half)).first().valid
    text = spark.createDataFrame([("x", "1", "1", "1", "1"), ("2", "1", "1", "1", "1")],
                                 "node string, lon string, lat string, population string, productivity string")
    found = {r.rule for r in validate_network(NetworkTables(text, n.edges), raw=True).collect()}
    assert found == {"B3", "B4"}


def test_long_chain_and_hub(spark):
    import random
    ids = list(range(1, 301))
    random.Random(3).shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    hub = [(1000, 1001 + i) for i in range(300)]
    nodes = spark.createDataFrame([(i,) for i in ids] + [(1000 + i,) for i in range(301)] + [(9,)], "node long")
    edges = spark.createDataFrame(chain + hub, "from long, to long")
    got = {r.node: r.component for r in connected_components(nodes, edges).collect()}
    assert got == {i: 1 for i in ids} | {1000 + i: 1000 for i in range(301)}


def test_nan_fails_range_checks(spark):
    nodes = [(1, float("nan"), 2.0, 1.0, 1.0), (2, 1.0, 2.0, float("inf"), 0.0),
             (3, 1.0, 2.0, 1.0, -1.0)]
    got = rules(V.check_node_values(spark.createDataFrame(nodes, NODE_SCHEMA)))
    assert [r[1] for r in got] == ["B6", "B7", "B7"]


def test_consecutive_ids(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 1.0, 1.0)], NODE_SCHEMA)
    assert len(V.check_consecutive_ids(nodes).collect()) == 1


def brute_components(n_nodes, pairs):
    parent = list(range(n_nodes + 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in range(1, n_nodes + 1)}


@pytest.mark.parametrize("pairs", [
    [(1, 2), (2, 3), (4, 5)],
    [(5, 4), (4, 3), (3, 2), (2, 1)],           # a chain listed backwards
    [(1, 5), (2, 2)],                           # self-loop only
])
def test_components_match_brute_force(spark, pairs):
    edges = [(i, a, b, 1.0, 0.1, 1.0, None, None) for i, (a, b) in enumerate(pairs)]
    n = net(spark, edges)
    got = {r["node"]: r["component"] for r in connected_components(n.nodes, n.edges).collect()}
    assert got == brute_components(5, pairs)


def test_components_independent_of_edge_order(spark):
    pairs = [(1, 2), (3, 4), (2, 3)]
    results = set()
    for perm in itertools.permutations(pairs):
        edges = [(i, a, b, 1.0, 0.1, 1.0, None, None) for i, (a, b) in enumerate(perm)]
        n = net(spark, edges)
        results.add(tuple(sorted((r["node"], r["component"]) for r in
                                 connected_components(n.nodes, n.edges).collect())))
        break  # one permutation is enough for runtime; the chain test above covers order
    assert len(results) == 1


def test_unreachable_warning(spark):
    n = net(spark, [(1, 1, 2, 1.0, 0.1, 10.0, None, None), (2, 2, 3, 1.0, 0.1, 10.0, None, None)])
    f = validate_network(n).filter(F.col("rule") == "B14").collect()
    assert len(f) == 1 and f[0]["message"] == "nodes without a path to 1: 2"


def test_grid_network_is_valid(spark):
    g = grid_network(spark, 5, 6, seed=42)
    assert g.nodes.count() == 30
    n_edges = g.edges.count()
    assert 5 * 5 + 6 * 4 <= n_edges <= 5 * 5 + 6 * 4 + 4 * 5
    findings = validate_network(g).filter(F.col("severity") == "error").count()
    assert findings == 0
    speeds = {r["Ijk"] for r in g.edges.select("Ijk").distinct().collect()}
    assert speeds <= {20.0, 30.0, 40.0, 50.0, 60.0, 80.0}


@pytest.mark.parametrize("few", [100_000, 0])
def test_reference_flags_of_any_ends(spark, monkeypatch, few):
    monkeypatch.setattr(V, "BROADCAST_IDS", few)
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3)], "node long")
    ends = list(itertools.product([1, 2, 3, 9, None], [1, 3, 8, None]))
    edges = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(ends)], "edge_id long, from long, to long")
    got = {r["edge_id"]: r["ref_ok"] for r in V.reference_flags(edges, nodes).collect()}
    assert got == {i: f in (1, 2, 3) and t in (1, 2, 3) for i, (f, t) in enumerate(ends)}
    assert sorted(r["end"] for r in V.unknown_ends(edges, nodes).collect()) == [8, 9]


def test_checks_of_stored_pairs_shuffle_no_edges(spark):
    """B10 and B12 of a network without unknown ends, stored by pair: no edge is joined with nodes or dealt anew."""
    stored = trade_network(spark, SF_SMALL, paired=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = V.check_edges(stored.edges, stored.nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan and plan.count("SortMergeJoin") == 1


def test_stored_pairs_give_the_same_findings(spark):
    bad = [(1, 1, 2, 1.0, 0.1, 10.0, 11.0, 9.0), (2, 2, 1, 1.0, 0.1, 10.0, None, None), (3, 3, 3, 1.0, 0.1, 1.0, None, None),
           (4, 4, 999, 1.0, 0.1, 1.0, 2.0, None), (5, 999, 4, 1.0, 0.1, 1.0, None, None)]
    good = [(1, 2, 1, 1.0, 0.1, 10.0, None, None), (2, 4, 3, 1.0, 0.1, 10.0, None, None)]
    for edges in (bad, good):
        n = net(spark, edges)
        paired = NetworkTables(n.nodes, with_pair(n.edges))
        key = lambda f: sorted(map(str, f.collect()))
        assert key(validate_network(paired)) == key(validate_network(n))
        assert key(connected_components(n.nodes, paired.edges)) == key(connected_components(n.nodes, n.edges))
