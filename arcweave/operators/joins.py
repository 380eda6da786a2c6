"""Joins (section 2D): endpoints, geometry resolution, keyed geometry attach.

Node-side lookups are plain equi-joins: the planner broadcasts the node table
when its measured size is under the broadcast threshold and otherwise uses a
sort-merge join, where AQE splits a hub node (a skewed key) across tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions import LINE_TYPE, parse_linestring, plainly_line, straight_line
from arcweave.operators.arcs import PAIR


def stores_pair(*tables: DataFrame) -> bool:
    """Whether all tables carry the canonical pair as columns."""
    return all(c in t.columns for t in tables for c in PAIR)


def join_by_pair(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)``, inner or left, for keys ``on`` that determine the pair.

    Where both tables store their pair, the pair is the only join key and ``on`` is compared as bounds in the
    condition, so that tables in buckets by pair are not shuffled: as keys, ``on`` would be dealt anew. A row meets
    the rows of its own pair, a few a run and good.
    """
    if not stores_pair(left, right):
        return left.join(right.drop(*PAIR), on, how)
    there = right.withColumnsRenamed({c: f"_{c}" for c in (*on, *PAIR)})
    same = [F.col(c) == F.col(f"_{c}") for c in PAIR]
    within = [F.col(c).between(F.col(f"_{c}"), F.col(f"_{c}")) for c in on]
    rest = [c for c in (*left.columns, *right.columns) if c not in (*on, *PAIR)]
    return left.join(there, reduce(and_, [*same, *within]), how).select(*[F.col(f"`{c}`") for c in (*on, *rest, *PAIR)])


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach ``lon_from, lat_from, lon_to, lat_to`` (null when the node is absent)."""
    a = nodes.select(F.col("node").alias("from"), F.col("lon").alias("lon_from"),
                     F.col("lat").alias("lat_from"))
    b = nodes.select(F.col("node").alias("to"), F.col("lon").alias("lon_to"),
                     F.col("lat").alias("lat_to"))
    return edges.join(a, "from", "left").join(b, "to", "left")


def ends_by_pair(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lon_lo, lat_lo, lon_hi, lat_hi`` beside each distinct canonical pair (null when the node is absent)."""
    lo = nodes.select(F.col("node").alias("pair_lo"), F.col("lon").alias("lon_lo"), F.col("lat").alias("lat_lo"))
    hi = nodes.select(F.col("node").alias("pair_hi"), F.col("lon").alias("lon_hi"), F.col("lat").alias("lat_hi"))
    return (pairs.select(*PAIR).distinct().join(lo, "pair_lo", "left").join(hi, "pair_hi", "left")
            .select(*PAIR, "lon_lo", "lat_lo", "lon_hi", "lat_hi"))


def _with_needed_endpoints(edges: DataFrame, nodes: DataFrame, geometry_col: str) -> DataFrame:
    """``with_endpoints`` for edges that store their pair; null also where the text surely is a line.

    Only pairs and coordinates are dealt by node and dealt back by pair: an edge is not shuffled where it is stored by pair.
    """
    needed = edges.filter(~plainly_line(geometry_col)) if geometry_col in edges.columns else edges
    at = edges.join(ends_by_pair(needed, nodes), list(PAIR), "left")

    def end(node: str, c: str) -> Column:
        return F.when(F.col(node) == F.col("pair_lo"), F.col(f"{c}_lo")).when(
            F.col(node) == F.col("pair_hi"), F.col(f"{c}_hi")).alias(f"{c}_{node}")

    return at.select(*[F.col(f"`{c}`") for c in edges.columns], *[end(n, c) for n in ("from", "to") for c in ("lon", "lat")])


def resolve_geometry(edges: DataFrame, nodes: DataFrame | None,
                     geometry_col: str = "geometry", undrawn: bool = False) -> DataFrame:
    """``line`` = parsed WKT, else the straight line between the endpoints; rows
    with neither are dropped (they cannot be drawn), or with ``undrawn`` kept with a null line.

    The text is parsed below the join with the nodes, so that what is built on ``line`` does not parse it again.
    """
    parsed = (parse_linestring(F.col(geometry_col)) if geometry_col in edges.columns
              else F.lit(None).cast(LINE_TYPE))
    out = edges.withColumn("line", parsed)
    if nodes is not None:
        ends = _with_needed_endpoints(out, nodes, geometry_col) if stores_pair(edges) else with_endpoints(out, nodes)
        line = F.coalesce(F.col("line"), straight_line("lon_from", "lat_from", "lon_to", "lat_to"))
        out = ends.withColumn("line", line).drop("lon_from", "lat_from", "lon_to", "lat_to")
    return out if undrawn else out.filter(F.col("line").isNotNull())


def attach_geometry(edges: DataFrame, geom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3: keyed geometry by ``(from, to)``; every edge must match.

    Returns (edges with ``geometry``, findings for edges without a geometry).
    Of several texts for one key the smallest is used (a partial aggregate), so the
    join cannot multiply edges; a warning names such an edge. Tables that store their pair are joined where they lie.
    """
    one = geom.groupBy("from", "to", *[c for c in PAIR if stores_pair(geom)]).agg(
        F.min("geometry").alias("geometry"), F.count(F.lit(1)).alias("_n"))
    joined = join_by_pair(edges, one, ["from", "to"], "left")
    pair = F.concat(F.col("from").cast("string"), F.lit("/"), F.col("to").cast("string"))
    findings = joined.filter(F.col("_n").isNull() | (F.col("_n") > 1)).select(
        F.when(F.col("_n").isNull(), "error").otherwise("warning").alias("severity"),
        F.lit("D3").alias("rule"), F.lit("edges").alias("entity"),
        F.col("edge_id").cast("long").alias("key"),
        F.when(F.col("_n").isNull(), F.concat(F.lit("no geometry for "), pair))
        .otherwise(F.concat(F.col("_n").cast("string"), F.lit(" geometries for "), pair)).alias("message"))
    joined = joined.drop("_n")
    return joined, findings
