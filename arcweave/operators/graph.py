"""Connected components (B15) and reachability (B14) as rounds of joins, whole or as a network grows.

Alternating large-star and small-star rounds: each round rewrites the edge table so that every
node points at a smaller one, until all point at the smallest of their component. Repeated edges
and loops go in every round, so a round costs what is still unsettled, and the number of rounds
grows with the logarithm of the largest component.

The minimum per node is a partial aggregate; the join that spreads it over a node's edges can be
split by AQE's skew-join rule when a hub node owns a large share of them. Each round's edges are
written with a reliable ``checkpoint()`` to the cluster's checkpoint folder, which cuts the
lineage and survives lost executors; the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.arcs import PAIR
from arcweave.session import ensure_checkpoint_dir


def _with_lowest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest v of its u."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def _mark(edges: DataFrame) -> tuple:
    # a decimal sum cannot overflow
    return tuple(edges.agg(F.count(F.lit(1)),
                           F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node of an edge but the smallest of its component, with that smallest one."""
    return _stars_of_pairs(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))


def _stars_of_pairs(pairs: DataFrame) -> DataFrame:
    """``_stars`` of edges that have their larger node in ``u``; those stored by pair are not shuffled for the first round."""
    now = pairs.filter(F.col("u") != F.col("v")).distinct().checkpoint()
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_lowest(both).filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct().checkpoint())
        low = _with_lowest(large)
        now = (low.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v")))
               .filter(F.col("u") != F.col("v")).distinct().checkpoint())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now


def connected_components(nodes: DataFrame, edges: DataFrame,
                         src: str = "from", dst: str = "to") -> DataFrame:
    """``(node, component)`` where ``component`` is the smallest node id reachable."""
    ensure_checkpoint_dir(nodes.sparkSession)
    if (src, dst) == ("from", "to") and all(c in edges.columns for c in PAIR):
        stars = _stars_of_pairs(edges.select(F.col("pair_hi").alias("u"), F.col("pair_lo").alias("v")))
    else:
        stars = _stars(edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")))
    return (nodes.select(F.col("node").cast("long").alias("node")).distinct()
            .join(stars, F.col("node") == F.col("u"), "left")
            .select("node", F.coalesce("v", "node").alias("component")))


def extend_components(components: DataFrame, edges: DataFrame, src: str = "from", dst: str = "to") -> DataFrame:
    """B15 after edges were added: ``(node, component)`` from the components before and the new edges only.

    Each end of a new edge stands for its component (or for itself, a node that was not known), so what is left
    is a graph of components with at most as many edges as were added. Rounds run on that graph;
    the known nodes are read twice, to look up ends and to rename components. Components
    stay named by their smallest node. The result has the lineage of ``components``; store it before the next step.
    """
    ensure_checkpoint_dir(components.sparkSession)
    known = components.select(F.col("node").cast("long").alias("node"), F.col("component").cast("long").alias("component"))
    new = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter(
        F.col("u").isNotNull() & F.col("v").isNotNull()).distinct()
    ends = new.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    label = (ends.join(known.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left")
             .select("node", F.coalesce("component", "node").alias("label"), F.col("known").isNull().alias("fresh"))
             .checkpoint())
    at = label.select("node", "label")
    links = (new.join(at.withColumnsRenamed({"node": "u", "label": "a"}), "u")
             .join(at.withColumnsRenamed({"node": "v", "label": "b"}), "v"))
    stars = _stars(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = known.unionByName(label.filter("fresh").select("node", F.col("label").alias("component")))
    return (nodes.join(stars, F.col("component") == F.col("u"), "left")
            .select("node", F.coalesce("v", "component").alias("component")))


def component_sizes(components: DataFrame) -> DataFrame:
    """Nodes per component."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
