"""Validate a network end to end into one findings table.

The rules run in stages, and a stage with errors ends the checks that build on it: required
columns, then types, then values for each table, then the rules across both tables if both were
accepted, then reachability. The stages of both tables are one job, whose findings (a few rows per column) are stored
once and cut at the first stage with an error; the driver then asks whether there was one, and once more after the
rules across both tables (one finding per bad edge).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.operators import validate as V
from arcweave.operators.graph import connected_components
from arcweave.session import ensure_checkpoint_dir
from arcweave.sources.fixtures import NetworkTables


def type_network(net: NetworkTables, raw: bool) -> tuple[NetworkTables, list[DataFrame]]:
    """Required columns, then typed tables (from text when ``raw``)."""
    findings = []
    nodes = edges = None
    if net.nodes is not None:
        nodes, found = _typed(net.nodes, "nodes", raw)
        findings += found
    if net.edges is not None:
        edges, found = _typed(net.edges, "edges", raw)
        findings += found
    return NetworkTables(nodes, edges), findings


def _typed(df: DataFrame, entity: str, raw: bool) -> tuple[DataFrame | None, list[DataFrame]]:
    is_nodes = entity == "nodes"
    required = V.NODE_REQUIRED if is_nodes else V.EDGE_REQUIRED
    ints = V.NODE_INT_COLS if is_nodes else V.EDGE_INT_COLS
    floats = V.NODE_FLOAT_COLS if is_nodes else V.EDGE_FLOAT_COLS
    more_floats = ["housing"] if is_nodes else V.EDGE_OPTIONAL_FLOAT
    more_ints = ["product"] if is_nodes else []
    missing = V.require_columns(df, required, entity)
    if any(c not in df.columns for c in required):
        return None, [missing]
    if raw:
        typed, found = V.coerce_table(df, entity, ints, floats, optional_float=more_floats, optional_int=more_ints)
        return typed, [missing, found]
    return V.typed_view(df, ints + more_ints, floats + more_floats), [missing]


def cross_checks(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """References first; rows with a bad endpoint skip the other edge rules."""
    return [V.check_edges(edges, nodes)]


def _node_stages(raw_nodes: DataFrame, raw: bool) -> tuple[DataFrame | None, list[list[DataFrame]]]:
    """The typed node table and the findings of each stage of its own rules."""
    nodes, found = _typed(raw_nodes, "nodes", raw)
    if nodes is None:
        return None, [found]
    nodes = V.drop_incomplete_housing(nodes)
    return nodes, [[*found, V.resolve_housing_policy(raw_nodes)], [V.check_consecutive_ids(nodes)],
                   [V.check_node_values(nodes)]]


def _edge_stages(raw_edges: DataFrame, raw: bool) -> tuple[DataFrame | None, list[list[DataFrame]]]:
    """The typed edge table and the findings of each stage of its own rules."""
    edges, found = _typed(raw_edges, "edges", raw)
    if edges is None:
        return None, [found]
    return edges, [found, [V.check_edge_values(edges)]]


def _until_error(sides: dict[str, list[list[DataFrame]]]) -> tuple[DataFrame, set[str]]:
    """(findings, sides with an error) of the stages of each side, each up to its first stage with an error.

    All stages of all sides are one job; a later stage may look at values that an earlier one refuses, and its
    findings are dropped then.
    """
    tagged = [f.select(*V.FINDING_COLUMNS, F.lit(side).alias("side"), F.lit(i).alias("stage"))
              for side, stages in sides.items() for i, stage in enumerate(stages) for f in stage]
    found = reduce(DataFrame.unionByName, tagged).checkpoint()
    ends = found.filter(F.col("severity") == "error").groupBy("side").agg(F.min("stage").alias("end"))
    kept = (found.join(F.broadcast(ends), "side", "left")  # at most one row a side
            .filter(F.col("end").isNull() | (F.col("stage") <= F.col("end"))).select(*V.FINDING_COLUMNS))
    return kept, {r["side"] for r in ends.collect()}


def validate_network(net: NetworkTables, raw: bool = False, root: int = 1,
                     reachability: bool = True) -> DataFrame:
    """All rules into one findings table.

    A nodes-only or edges-only network gets its own rules and a finding of severity ``info``,
    which makes ``findings_summary`` report it as not valid.
    """
    spark: SparkSession = (net.nodes if net.nodes is not None else net.edges).sparkSession
    ensure_checkpoint_dir(spark)
    nodes = edges = None
    sides = {}
    if net.nodes is not None:
        nodes, sides["nodes"] = _node_stages(net.nodes, raw)
    if net.edges is not None:
        edges, sides["edges"] = _edge_stages(net.edges, raw)
    found, bad = _until_error(sides)
    parts = [found]
    if net.nodes is None or net.edges is None:
        here, other = ("edges", "nodes") if net.nodes is None else ("nodes", "edges")
        parts.append(spark.createDataFrame(
            [("info", "B17", here, None, f"{here} present, {other} absent")], V.FINDINGS_SCHEMA))
    elif nodes is not None and edges is not None and not bad:
        cross, bad = _until_error({"both": [cross_checks(nodes, edges)]})
        parts.append(cross)
        if reachability and not bad:
            parts.append(V.unreachable_finding(connected_components(nodes, edges), root))
    return V.union_findings(parts)
