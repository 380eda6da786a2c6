"""Synthetic grid network of any size (rook grid plus random diagonals).

Every random draw is a hash of (seed, node id, draw number), so a node's
coordinates, population and speeds are pure functions of its id: edges compute
their endpoints without joining the node table, and the generator is one
distributed ``range`` plus projections at any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from arcweave.functions import curved_line, haversine_km, iceberg_cost, to_linestring
from arcweave.sources.fixtures import NetworkTables

# Fixed values of the example generator: grid extent, jitter, speed classes and
# their cumulative weights, cost factors, diagonal probability.
LON_RANGE = (9.5, 15.5)
LAT_RANGE = (2.0, 7.0)
JITTER_LON, JITTER_LAT = 0.5, 0.4
SPEEDS = [20.0, 30.0, 40.0, 50.0, 60.0, 80.0]
SPEED_CUM = [0.22, 0.44, 0.64, 0.80, 0.92, 1.00]
DIAGONAL_P = 0.25
COST_PER_KM = 0.03
CURVE = 0.15
POP_MU, POP_SIGMA = 4.6, 0.8
DELTA_TAU_FLOOR = 0.005
UPPER = 100.0

_TWO53 = float(2 ** 53)


def uniform(seed: int, key: Column, draw: int) -> Column:
    """Uniform [0, 1) from a 64-bit hash of (seed, key, draw)."""
    h = F.xxhash64(F.lit(seed), key, F.lit(draw))
    return (F.abs(h % F.lit(2 ** 53)).cast("double")) / F.lit(_TWO53)


def normal(seed: int, key: Column, draw: int) -> Column:
    """Standard normal by Box–Muller from two hashed uniforms."""
    u1 = F.greatest(uniform(seed, key, draw), F.lit(1e-12))
    u2 = uniform(seed, key, draw + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def _axis(i: Column, n: int, lo: float, hi: float) -> Column:
    step = (hi - lo) / max(n - 1, 1)
    return F.lit(lo) + i.cast("double") * F.lit(step)


def _coords(node: Column, n_rows: int, n_cols: int, seed: int) -> tuple[Column, Column]:
    idx = node - 1
    r, c = (idx / n_cols).cast("long"), idx % n_cols
    lon = F.round(_axis(c, n_cols, *LON_RANGE) + F.lit(JITTER_LON) * (uniform(seed, node, 1) - 0.5), 4)
    lat = F.round(_axis(r, n_rows, *LAT_RANGE) + F.lit(JITTER_LAT) * (uniform(seed, node, 2) - 0.5), 4)
    return lon, lat


def _speed(u: Column) -> Column:
    expr = F.lit(SPEEDS[-1])
    for s, cum in reversed(list(zip(SPEEDS, SPEED_CUM))):
        expr = F.when(u <= F.lit(cum), F.lit(s)).otherwise(expr)
    return expr


def grid_network(spark: SparkSession, n_rows: int, n_cols: int, seed: int = 42) -> NetworkTables:
    """Nodes ``1..R·C`` on a jittered grid with skewed populations; edges to the right
    and below, plus a diagonal with probability 0.25; speeds from the cumulative table."""
    node = F.col("id") + 1
    lon, lat = _coords(node, n_rows, n_cols, seed)
    pop = F.round(F.exp(normal(seed, node, 3) * POP_SIGMA + POP_MU), 1)
    prod = F.round(F.lit(2.0) + F.lit(2.0) * uniform(seed, node, 5)
                   + F.lit(1.2) * F.log10(pop / 100 + 1), 3)
    nodes = spark.range(n_rows * n_cols).select(
        node.alias("node"), lon.alias("lon"), lat.alias("lat"), pop.alias("population"),
        prod.alias("productivity"), F.round(pop * 0.3, 2).alias("housing"),
        F.concat(F.lit("City-"), F.when(node < 10, "0").otherwise(""), node.cast("string")).alias("name"))

    idx = F.col("id")
    r, c = (idx / n_cols).cast("long"), idx % n_cols
    src = idx + 1
    offsets = F.array(
        F.struct(F.lit(1).alias("k"), F.when(c < n_cols - 1, src + 1).alias("dst")),
        F.struct(F.lit(2).alias("k"), F.when(r < n_rows - 1, src + n_cols).alias("dst")),
        F.struct(F.lit(3).alias("k"),
                 F.when((r < n_rows - 1) & (c < n_cols - 1)
                        & (uniform(seed, src, 7) < DIAGONAL_P), src + n_cols + 1).alias("dst")))
    pairs = (spark.range(n_rows * n_cols)
             .select(src.alias("from"), F.inline(offsets))
             .filter(F.col("dst").isNotNull())
             .select("from", F.col("dst").alias("to"), "k"))
    f, t = F.col("from"), F.col("to")
    key = f * F.lit(4) + F.col("k")
    lf, af = _coords(f, n_rows, n_cols, seed)
    lt, at = _coords(t, n_rows, n_cols, seed)
    km = haversine_km(lf, af, lt, at)
    ijk = _speed(uniform(seed, key, 11))
    off = F.lit(CURVE) * (uniform(seed, key, 13) - 0.5)
    edges = pairs.select(
        key.alias("edge_id"), "from", "to",  # 4·from + direction: unique, no id packing
        F.round(km * COST_PER_KM * (F.lit(0.8) + F.lit(0.4) * uniform(seed, key, 12)), 4).alias(
            "delta_i"),
        F.round(iceberg_cost(km, DELTA_TAU_FLOOR), 5).alias("delta_tau"),
        ijk.alias("Ijk"), ijk.alias("Il"), F.lit(UPPER).alias("Iu"),
        to_linestring(curved_line(lf, af, lt, at, off)).alias("geometry"))
    return NetworkTables(nodes, edges)
