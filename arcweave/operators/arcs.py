"""Edge/arc conversions and model inputs.

An undirected edge list has one row per pair; the directed arc table has two rows
per edge. Dense J×J matrices never appear: absent arcs are absent rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions.util import finite_or_null

PAIR = ("pair_lo", "pair_hi")


def pair_lo(a="from", b="to") -> Column:
    return F.least(F.col(a), F.col(b))


def pair_hi(a="from", b="to") -> Column:
    return F.greatest(F.col(a), F.col(b))


def to_arcs(edges: DataFrame, src: str = "from", dst: str = "to") -> DataFrame:
    """G1: both orientations of every edge, carrying all other columns unchanged.

    One scan and an ``inline`` of an array without a lambda, instead of a union of two
    scans. A self-loop is one matrix cell, so it yields a single arc.
    """
    others = [c for c in edges.columns if c not in (src, dst)]
    there = F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    back = F.struct(F.col(dst).alias("src"), F.col(src).alias("dst"))
    ways = F.when(F.col(src) != F.col(dst), F.array(there, back)).otherwise(F.array(there))
    return edges.select(F.inline(ways), *others)


def to_pairs(arcs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Directed arcs -> distinct undirected canonical pairs ``(pair_lo, pair_hi)``."""
    return (arcs.select(*keys, pair_lo("src", "dst").alias("pair_lo"),
                        pair_hi("src", "dst").alias("pair_hi"))
            .distinct())


def arc_weight() -> Column:
    """Weight of an arc in the mean of both directions.

    ``(M[f,t] + M[t,f])/2``: each off-diagonal arc counts half; a diagonal arc
    (self-loop) is both directions at once and counts fully.
    """
    return F.when(F.col("src") == F.col("dst"), F.lit(1.0)).otherwise(F.lit(0.5))


def symmetrise(arcs: DataFrame, value_cols: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Pre-aggregate arc values on the canonical pair: ``Σ w·v`` per pair.

    Absent directions count as zero (dense-matrix semantics). One shuffle on the
    pair key; joining the result to edges on the same key reuses that partitioning.
    """
    w = arc_weight()
    aggs = [F.sum(F.col(c) * w).alias(c) for c in value_cols]
    return arcs.groupBy(*keys, *pair_columns(arcs)).agg(*aggs)


def pair_columns(df: DataFrame, a: str = "src", b: str = "dst") -> list[Column]:
    """The canonical pair: the columns of a table that stores it, or else derived from its two ends."""
    if all(c in df.columns for c in PAIR):
        return [F.col(c) for c in PAIR]
    return [pair_lo(a, b).alias("pair_lo"), pair_hi(a, b).alias("pair_hi")]


def with_pair(edges: DataFrame, a: str = "from", b: str = "to") -> DataFrame:
    return edges.select(*[F.col(f"`{c}`") for c in edges.columns if c not in PAIR], *pair_columns(edges, a, b))


def effective_bounds(edges: DataFrame, allow_downgrade: bool = False) -> DataFrame:
    """Model bounds. ``Il_eff = min(Il, Ijk)`` if given, else 0 or ``Ijk``;
    ``Iu_eff = max(Iu, Ijk)`` if given, else null (unbounded)."""
    ijk = F.col("Ijk")
    # Non-finite bounds (e.g. an 'Inf' upper bound) mean "unbounded" / "no value".
    il = finite_or_null(F.col("Il")) if "Il" in edges.columns else F.lit(None).cast("double")
    iu = finite_or_null(F.col("Iu")) if "Iu" in edges.columns else F.lit(None).cast("double")
    default_il = F.lit(0.0) if allow_downgrade else ijk
    return edges.withColumn("Il_eff", F.when(il.isNotNull(), F.least(il, ijk)).otherwise(
        default_il)).withColumn("Iu_eff", F.when(iu.isNotNull(), F.greatest(iu, ijk)))


def housing_policy(nodes: DataFrame) -> DataFrame:
    """B4 scalar: one-row frame ``housing_ok`` — true only if the column exists and has no nulls."""
    if "housing" not in nodes.columns:
        return nodes.sparkSession.range(1).select(F.lit(False).alias("housing_ok"))
    return nodes.agg(F.coalesce(F.bool_and(F.col("housing").isNotNull()),
                                F.lit(True)).alias("housing_ok"))


def effective_housing(nodes: DataFrame, alpha) -> DataFrame:
    """``housing`` if usable (B4), else ``population·(1−alpha)``, as column ``Hj``."""
    alpha = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    fallback = F.col("population") * (F.lit(1.0) - alpha)
    if "housing" not in nodes.columns:
        return nodes.withColumn("Hj", fallback)
    policy = F.broadcast(housing_policy(nodes))  # one row
    return (nodes.crossJoin(policy)
            .withColumn("Hj", F.when(F.col("housing_ok"), F.col("housing")).otherwise(fallback))
            .drop("housing_ok"))


def productivity_long(nodes: DataFrame, goods: DataFrame | None = None,
                      floor: float | None = None) -> DataFrame:
    """Node × good productivity ``(node, good, z)``.

    Without a floor only each node's own good is non-zero, so the table is a
    projection (zeros are implicit). With a floor every node gets every good:
    the goods ``1..N`` are generated per node with ``explode(sequence(1, N))``
    where N comes from a one-row aggregate.
    """
    own = F.col("product") if "product" in nodes.columns else F.lit(1)
    if floor is None:
        return nodes.select("node", own.cast("int").alias("good"),
                            F.col("productivity").alias("z"))
    if goods is None:
        n_goods = F.broadcast(nodes.agg(F.max(own).alias("_n_goods")))  # one row
        grid = (nodes.crossJoin(n_goods)
                .withColumn("good", F.explode(F.sequence(F.lit(1), F.col("_n_goods")))))
    else:
        from arcweave.operators.util import attach_rows
        grid = attach_rows(nodes, goods.select("good"))
    z = F.when(F.col("good") == own, F.col("productivity")).otherwise(F.lit(0.0))
    return grid.select("node", F.col("good").cast("int").alias("good"),
                       F.greatest(z, F.lit(float(floor))).alias("z"))
