"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round rewrites the edges so that each node points at a smaller one, until all point at
the smallest of their component; the number of rounds grows with the logarithm of the largest
component. The minimum per node is a partial aggregate and the join that spreads it can be split
for a hub node by the skew-join rule. Edges are stored each round in the shared folder; the
driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import stored


def _spread(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest v of its u."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(low, "u")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, label) for every node of an edge that is no loop; label is the smallest node of the component."""
    a, b = F.col(src), F.col(dst)
    now = stored(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
                 "edges")
    mark = _mark(now)
    while mark[0]:
        # large star: the larger neighbours of a node point at the smallest of it and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_spread(both).filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        # small star: a node and its smaller neighbours point at the smallest of them
        spread = _spread(stored(large, "large-star"))
        small = (spread.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(spread.select("u", F.col("m").alias("v")))
                 .filter(F.col("u") != F.col("v")).distinct())
        now = stored(small, "small-star")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    low = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(low)


def extend(label: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, label) when ``edges`` are added to the edges that ``label`` comes from.

    Rounds run on the graph of labels only, which has at most as many edges as were added.
    """
    def of(node: str, out: str) -> DataFrame:
        return label.select(F.col("node").alias(node), F.col("label").alias(out))

    links = (edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
             .join(of("u", "lu"), "u", "left").join(of("v", "lv"), "v", "left")
             .select("u", "v", F.coalesce("lu", "u").alias("a"), F.coalesce("lv", "v").alias("b")))
    links = stored(links, "label-links")
    roots = components(links, "a", "b").select(F.col("node").alias("r"), F.col("label").alias("root"))
    ends = links.select(F.col("u").alias("node"), F.col("a").alias("label")).union(links.select("v", "b"))
    nodes = label.select("node", "label").union(ends).distinct()
    return nodes.join(roots, F.col("label") == F.col("r"), "left").select("node", F.coalesce("root", "label").alias("label"))
