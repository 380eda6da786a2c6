"""Result tables, budgets and scaling: golden rows and invariants."""

import pytest
from pyspark.sql import functions as F

from conftest import rows

from arcweave.functions import parse_linestring, plainly_line
from arcweave.operators import aggregates as A
from arcweave.operators.arcs import symmetrise, to_arcs, with_pair
from arcweave.operators.joins import resolve_geometry
from arcweave.plans.publish import scaled_features
from arcweave.plans.results import edge_table
from arcweave.sources.fixtures import NetworkTables

EDGES = [(1, 1, 2, 2.0, 0.1, 10.0, None, 20.0), (2, 2, 3, 1.0, 0.2, 30.0, None, None),
         (3, 3, 3, 1.0, 0.2, 5.0, None, None)]
EDGE_SCHEMA = ("edge_id long, from long, to long, delta_i double, delta_tau double, Ijk double, "
               "Il double, Iu double")


def test_symmetrise_of_arcs_is_identity(spark):
    e = spark.createDataFrame(EDGES, EDGE_SCHEMA)
    s = symmetrise(to_arcs(e.select("from", "to", "Ijk")), ["Ijk"])
    got = sorted((r["pair_lo"], r["pair_hi"], r["Ijk"]) for r in s.collect())
    assert got == [(1, 2, 10.0), (2, 3, 30.0), (3, 3, 5.0)]


def test_budget_identity(spark):
    # valid networks have no self-loops (B11); then arcs cost exactly twice the edges
    e = spark.createDataFrame(EDGES[:2], EDGE_SCHEMA)
    arcs = to_arcs(e.select("from", "to", "delta_i", F.col("Ijk").alias("ijk")))
    spent = A.budget_spent(arcs).first()["spent"]
    k_base = A.budget_stats(e).first()["K_base"]
    assert spent == pytest.approx(2 * k_base)
    same = A.rescale_to_budget(arcs, spent)
    assert sorted(r["ijk"] for r in same.collect()) == sorted(r["ijk"] for r in arcs.collect())


def test_budget_stats_suggestion(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0, 0.1, 10.0, None, 100.0)], EDGE_SCHEMA)
    r = A.budget_stats(e).first()
    assert (r["K_base"], r["K_max"], r["K_suggested"]) == (10.0, 100.0, 12.0)
    r2 = A.budget_stats(spark.createDataFrame(EDGES, EDGE_SCHEMA)).first()
    assert r2["K_max"] is None and r2["K_suggested"] == pytest.approx(1.2 * r2["K_base"])


def test_edge_table_golden(spark):
    e = spark.createDataFrame(EDGES[:2], EDGE_SCHEMA)
    infra = spark.createDataFrame(
        [("r", 1, 2, 14.0), ("r", 2, 1, 16.0), ("r", 2, 3, 30.0), ("r", 3, 2, 30.0)],
        "run_id string, src long, dst long, ijk double")
    flow = spark.createDataFrame(
        [("r", 1, 2, 1, 4.0), ("r", 2, 1, 2, 2.0), ("r", 3, 2, 1, 6.0)],
        "run_id string, src long, dst long, good int, q double")
    t = edge_table(NetworkTables(None, e), infra, flow, "r", n_goods=2)
    got = {(r["from"], r["to"]): r for r in t.collect()}
    a, b = got[(1, 2)], got[(2, 3)]
    assert (a["Ijk"], a["increase"], a["perc_upgraded"]) == (15.0, 5.0, 50.0)
    assert (a["Qjk_1"], a["Qjk_2"], a["Qjk_total"]) == (2.0, 1.0, 3.0)
    # unbounded edge: the cap is the largest finite Iu (20): no headroom -> 0
    assert (b["Ijk"], b["increase"], b["perc_upgraded"], b["Qjk_total"]) == (30.0, 0.0, 0.0, 3.0)


def test_scaled_features_in_unit_interval(spark):
    df = spark.createDataFrame([(1, 0.0, -1.0), (2, 50.0, 10.0), (3, 100.0, 100.0)],
                               "id long, perc_upgraded double, q double")
    out = scaled_features(df, {"perc_upgraded": "level", "q": "log"}, ["id"]).collect()
    vals = {r["id"]: (r["perc_upgraded_scaled"], r["q_scaled"]) for r in out}
    assert vals[2][0] == 0.5 and vals[1][1] is None
    assert vals[2][1] == 0.0 and vals[3][1] == 1.0


def test_metric_catalogue_percent_domain(spark):
    df = spark.createDataFrame([(1.0, 10.0, 3.0), (2.0, 20.0, None)],
                               "Ijk double, perc_upgraded double, Qjk_total double")
    cat = {r["key"]: r for r in A.edge_metric_catalogue(df).collect()}
    assert (cat["perc_upgraded"]["min"], cat["perc_upgraded"]["max"]) == (0.0, 100.0)
    assert (cat["Ijk"]["min"], cat["Ijk"]["max"]) == (1.0, 2.0)
    assert [k for k in sorted(cat, key=lambda k: cat[k]["position"])] == [
        "Ijk", "perc_upgraded", "Qjk_total"]


def test_attach_rows_has_no_bound(spark):
    from arcweave.operators.util import attach_rows
    df = spark.range(3).withColumnRenamed("id", "x")
    params = spark.createDataFrame([(1, 0.5), (2, 0.7)], "scenario_id int, alpha double")
    out = attach_rows(df, params)
    assert out.count() == 6 and set(out.columns) == {"x", "scenario_id", "alpha"}
    many = spark.range(150_000).withColumnRenamed("id", "scenario_id")
    assert attach_rows(df, many).distinct().count() == 450_000


def test_edge_table_cap_without_any_bound(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0, 0.1, 10.0, None, None),
                               (2, 2, 3, 1.0, 0.1, 30.0, None, None)], EDGE_SCHEMA)
    infra = spark.createDataFrame([("r", 1, 2, 20.0), ("r", 2, 1, 20.0), ("r", 2, 3, 30.0),
                                   ("r", 3, 2, 30.0)], "run_id string, src long, dst long, ijk double")
    t = {(r["from"], r["to"]): r["perc_upgraded"] for r in
         edge_table(NetworkTables(None, e), infra, None, "r").collect()}
    # cap = max(new, old) = 30: edge 1-2 went 10 -> 20 of a 20-wide headroom
    assert t == {(1, 2): 50.0, (2, 3): 0.0}


def test_lines_of_edges_stored_by_pair(spark):
    """D2 over edges with their pair gives the lines of D2 over edges without, for any text and any ends."""
    nodes = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, None)], "node long, lon double, lat double")
    texts = [None, "", "POINT (1 2)", "LINESTRING (0.5 1, -2 3.25)", "linestring(1 2, 3 4)", "LINESTRING (1 2)",
             "LINESTRING (1 2, 3)", "LINESTRING (1 2, 3 4 9)", "LINESTRING (1e3 2, 3 4)", "LINESTRING (1 2, 3 4) x",
             "LINESTRING (1. 2, 3 4)", "LINESTRING (x 2, 3 4)", "LINESTRING (" + ", ".join(["1.5 -2.5"] * 20000) + ")"]
    ends = [(1, 2), (2, 1), (1, 1), (1, 3), (1, 9), (9, 2), (None, 2), (1, None), (None, None)]
    edges = spark.createDataFrame([(i * 100 + j, f, t, g) for i, (f, t) in enumerate(ends) for j, g in enumerate(texts)],
                                  "edge_id long, `from` long, `to` long, geometry string")
    plain = resolve_geometry(edges, nodes, undrawn=True).select("edge_id", "line")
    paired = resolve_geometry(with_pair(edges), nodes, undrawn=True).select("edge_id", "line")
    assert rows(paired) == rows(plain) and plain.count() == len(ends) * len(texts)
    drawn = plain.filter("line is not null")
    assert rows(resolve_geometry(with_pair(edges), nodes).select("edge_id", "line")) == rows(drawn)
    sure = edges.filter(plainly_line("geometry"))
    assert sure.filter(parse_linestring("geometry").isNull()).count() == 0
    assert sure.select("geometry").distinct().count() == 2
