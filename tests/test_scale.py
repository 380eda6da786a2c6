"""Plans and generated code of steps that every query of the trade network shares."""

import re

from pyspark.sql import functions as F

from arcweave.checks import q_validate
from arcweave.checks.catalog import all_queries
from arcweave.operators.arcs import to_arcs
from arcweave.plans.etl import derive_edge_attributes
from arcweave.sources import fixtures as X
from arcweave.sources import variants as VA

from conftest import SF_SMALL, rows


def largest_method(df):
    """Bytes of the largest generated method; beyond 8,000 the JVM runs it interpreted."""
    debug = getattr(df._sc._jvm.org.apache.spark.sql.execution.debug, "package$")
    text = getattr(debug, "MODULE$").codegenString(df._jdf.queryExecution().executedPlan())
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_tables_by_pair_are_derived_without_a_shuffle(spark):
    X.fixture_store(spark, SF_SMALL)
    facts = X.stored(spark, SF_SMALL, "line_facts", paired=True)
    plan = X.flow_from_facts(facts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    edges = X.stored(spark, SF_SMALL, "edges", paired=True)
    assert "Exchange" not in X.trade_arc_infra(edges)._jdf.queryExecution().executedPlan().toString()


def test_arcs_are_made_in_compiled_code(spark):
    edges = spark.createDataFrame([(1, 2, 5), (3, 3, 6), (4, None, 7), (None, 4, 8)], "`from` long, `to` long, k int")
    arcs = to_arcs(edges)
    assert "lambda" not in arcs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, arcs.collect()), key=repr) == sorted(
        [(1, 2, 5), (2, 1, 5), (3, 3, 6), (4, None, 7), (None, 4, 8)], key=repr)


def test_edges_are_numbered_before_their_columns_are_made(spark):
    pairs = X.numbered_pairs(X.stored(spark, SF_SMALL, "line_facts", paired=True))
    assert pairs.columns == ["edge_id", "from", "to", "qty"]
    ordered = [r["edge_id"] for r in pairs.orderBy("from", "to").collect()]
    assert ordered == list(range(1, len(ordered) + 1))
    cols = ["edge_id", "from", "to", "Ijk", "geometry"]
    assert rows(X.edge_columns(pairs), *cols[:4]) == rows(X.trade_edges(spark, SF_SMALL), *cols[:4])


def test_generated_methods_are_small_enough_to_be_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        e = X.trade_edges(spark, SF_SMALL)
        made = e.select(X.edge_geometry_text(F.col("from"), F.col("to")).alias("geometry"))
        for df in (made, *[all_queries()[q].run(spark, SF_SMALL) for q in ("f1_edge_table", "f6_etl_network_edges")]):
            assert largest_method(df) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_speed_findings_work_the_formula_out_once(spark):
    raw = VA.raw_tables(spark, SF_SMALL)[1]
    plan = derive_edge_attributes(raw)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("ASIN(") == 2  # once in the distance and once in the duration of the raw table


def test_growing_components_join_the_edges_once(spark, monkeypatch):
    parts = []

    def extend(components, edges):
        parts.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return components

    monkeypatch.setattr(q_validate, "extend_components", extend)
    q_validate._grown_components(spark, SF_SMALL)
    assert len(parts) == 3 and not any("Join" in p for p in parts)
