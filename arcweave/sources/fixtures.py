"""Networks derived from the supplied TPC-H-style tables (see FIXTURES.md section 3).

NET-T, the trade network, grows with the scale factor: suppliers and customers
are nodes, every (supplier, customer) pair with at least one shipped line is an
edge, and the shipped lines become the flow allocations of two runs. All of it
is built with scans, joins and aggregations; nothing passes through the driver.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions import fixed_point_text, haversine_km, iceberg_cost, utility
from arcweave.operators.arcs import PAIR, to_arcs
from arcweave.operators.windows import sequence_number
from arcweave.session import scratch_dir
from arcweave.sources.buckets import deal_by_pair, write_dealt

# Fixed values of the fixture construction (shared with the SQL oracle).
LON_MULT, LON_MOD, LON_SHIFT = 7919, 36000, 18000
LAT_MULT, LAT_MOD, LAT_SHIFT = 104729, 18000, 9000
IJK_BASE, IJK_MOD = 20, 61
IU_VALUE, IU_NULL_MOD = 100.0, 7
IL_NULL_MOD = 5
DELTA_I_MULT, DELTA_I_MOD = 31, 97
GEOM_POINT_MOD, GEOM_NULL_MOD = 11, 13
N_GOODS_FROM_PARTS = 5
BASELINE_CUTOFF = "1999-01-01"
DELTA_TAU_FLOOR = 0.005
RUN_RESULT, RUN_BASELINE = "result", "baseline"
TRADE_PARAMS = {"alpha": 0.5, "beta": 1.0, "gamma": 1.0, "rho": 2.0, "sigma": 5.0,
                "a": 0.8, "nu": 2.0}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events")


@dataclass
class NetworkTables:
    """A network as two tables; either may be missing (nodes-only / edges-only)."""
    nodes: DataFrame | None
    edges: DataFrame | None


@dataclass
class Allocations:
    """Outputs of an external solve, keyed by ``run_id``."""
    arc_infra: DataFrame
    arc_flow: DataFrame
    node_alloc: DataFrame
    node_output: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def node_lon(node) -> "F.Column":
    return ((node * F.lit(LON_MULT)) % F.lit(LON_MOD) - F.lit(LON_SHIFT)) / F.lit(100)


def node_lat(node) -> "F.Column":
    return ((node * F.lit(LAT_MULT)) % F.lit(LAT_MOD) - F.lit(LAT_SHIFT)) / F.lit(100)


def _lon_hundredths(node):
    return (node * F.lit(LON_MULT)) % F.lit(LON_MOD) - F.lit(LON_SHIFT)


def _lat_hundredths(node):
    return (node * F.lit(LAT_MULT)) % F.lit(LAT_MOD) - F.lit(LAT_SHIFT)


def supplier_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row frame ``n_sup``: customer node ids start after the suppliers."""
    return read_table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_sup"))


def build_trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NET-T nodes: suppliers then customers, ids 1..S+C."""
    supplier = read_table(spark, sf_dir, "supplier")
    customer = read_table(spark, sf_dir, "customer")
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    nation = read_table(spark, sf_dir, "nation")

    shipped = lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(
        F.count(F.lit(1)).alias("n"))
    placed = orders.groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))

    sup = (supplier.join(shipped, supplier.s_suppkey == shipped.key, "left")
           .select((F.col("s_suppkey") + 1).alias("node"),
                   F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                   F.col("s_acctbal").alias("acctbal"),
                   F.col("s_nationkey").alias("nationkey"),
                   F.col("s_name").alias("name")))
    # The supplier count is a one-row frame: broadcasting it is size-proven.
    cus = (customer.crossJoin(F.broadcast(supplier_count(spark, sf_dir)))
           .join(placed, customer.c_custkey == placed.key, "left")
           .select((F.col("n_sup") + F.col("c_custkey") + 1).alias("node"),
                   F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                   F.col("c_acctbal").alias("acctbal"),
                   F.col("c_nationkey").alias("nationkey"),
                   F.col("c_name").alias("name")))
    # nation is tiny; the planner broadcasts it from its measured size.
    nat = nation.select(F.col("n_nationkey").alias("nationkey"),
                        (F.col("n_regionkey") + 1).cast("int").alias("product"))
    node = F.col("node").cast("long")
    return (sup.unionByName(cus).join(nat, "nationkey", "left")
            .select(node.alias("node"),
                    node_lon(node).alias("lon"),
                    node_lat(node).alias("lat"),
                    F.greatest(F.lit(1), F.col("n")).cast("double").alias("population"),
                    (F.abs(F.col("acctbal")) / 1000).alias("productivity"),
                    F.col("product"),
                    F.col("name"),
                    F.col("nationkey").cast("int").alias("nationkey")))


LINE_COLUMNS = ("l_partkey", "l_quantity", "l_returnflag", "l_shipdate")


def trade_lines(spark: SparkSession, sf_dir: str, columns: tuple = LINE_COLUMNS) -> DataFrame:
    """Shipped lines with their supplier and customer node ids (lineitem ⋈ orders).

    ``columns`` are names or expressions of lineitem, worked out before the join, so that only they are shuffled.
    """
    lineitem = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", *columns)
    kept = lineitem.columns[2:]
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
            .crossJoin(F.broadcast(supplier_count(spark, sf_dir)))
            .select((F.col("l_suppkey") + 1).cast("long").alias("supp_node"),
                    (F.col("n_sup") + F.col("o_custkey") + 1).cast("long").alias("cust_node"),
                    *kept))


def trade_fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines with what ``trade_line_facts`` groups by: a few small values instead of keys, texts and dates."""
    return trade_lines(spark, sf_dir, (
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_partkey") % N_GOODS_FROM_PARTS + 1).cast("int").alias("good"),
        (F.col("l_shipdate") < F.lit(BASELINE_CUTOFF).cast("timestamp")).alias("early"),
        "l_quantity"))


def edge_geometry_text(f, t) -> "F.Column":
    """Three-point LINESTRING through the chord midpoint, a POINT, or null, by id modulus.

    A point and a line share the text of their first pair: a generated method of more than 8,000 bytes is never compiled.
    """
    s = f + t
    lon_f, lat_f = _lon_hundredths(f) * 10, _lat_hundredths(f) * 10
    lon_t, lat_t = _lon_hundredths(t) * 10, _lat_hundredths(t) * 10
    mid_lon, mid_lat = (lon_f + lon_t) / 2, (lat_f + lat_t) / 2

    def pair(x, y):
        return F.concat(fixed_point_text(x, 3), F.lit(" "), fixed_point_text(y, 3))

    is_point = s % GEOM_POINT_MOD == 0
    rest = F.concat(F.lit(", "), pair(mid_lon, mid_lat), F.lit(", "), pair(lon_t, lat_t))
    text = F.concat(F.when(is_point, F.lit("POINT (")).otherwise(F.lit("LINESTRING (")), pair(lon_f, lat_f),
                    F.when(is_point, F.lit("")).otherwise(rest), F.lit(")"))
    return F.when(s % GEOM_NULL_MOD != 0, text)


def trade_line_facts(lines: DataFrame) -> DataFrame:
    """Shipped quantity per (supplier, customer, returned, good, shipped before the
    cutoff): the single aggregation of the line-level join that both the edges and
    the flows are derived from (partial aggregation before the shuffle)."""
    return lines.groupBy("supp_node", "cust_node", "returned", "good", "early").agg(F.sum("l_quantity").alias("q"))


def numbered_pairs(facts: DataFrame) -> DataFrame:
    """``edge_id``, ``from``, ``to``, ``qty``: one row per (supplier, customer) pair with at least one line.

    ``edge_id`` is the pair's position in ``(from, to)`` order, numbered
    distributedly (customer ids exceed 2^32 at the largest scales, so packing both
    ids into one long would collide). The other columns follow from these, so only these are sorted and shuffled.
    """
    stored_pair = [c for c in PAIR if c in facts.columns]  # no exchange where the facts are stored by pair
    pairs = facts.groupBy(F.col("supp_node").alias("from"), F.col("cust_node").alias("to"), *stored_pair).agg(
        F.sum("q").alias("qty")).select("from", "to", "qty")
    return sequence_number(pairs, ["from", "to"], "edge_id").select("edge_id", "from", "to", "qty")


def edge_columns(pairs: DataFrame) -> DataFrame:
    """NET-T edges from ``numbered_pairs``; the pair columns, if there are any, stay last."""
    f, t = F.col("from"), F.col("to")
    s = f + t
    ijk = (F.lit(IJK_BASE) + F.floor(F.col("qty")) % F.lit(IJK_MOD)).cast("double")
    km = haversine_km(node_lon(f), node_lat(f), node_lon(t), node_lat(t))
    return pairs.select(
        "edge_id", f.alias("from"), t.alias("to"),
        (F.lit(1.0) + ((f * F.lit(DELTA_I_MULT) + t) % F.lit(DELTA_I_MOD)) / F.lit(10)).alias(
            "delta_i"),
        iceberg_cost(km, DELTA_TAU_FLOOR).alias("delta_tau"),
        ijk.alias("Ijk"),
        F.when(s % IL_NULL_MOD != 0, ijk).alias("Il"),
        F.when(s % IU_NULL_MOD != 0, F.lit(IU_VALUE)).alias("Iu"),
        edge_geometry_text(f, t).alias("geometry"),
        *[c for c in PAIR if c in pairs.columns])


def edges_from_facts(facts: DataFrame) -> DataFrame:
    """NET-T edges: one per (supplier, customer) pair with at least one line."""
    return edge_columns(numbered_pairs(facts))


def flow_from_facts(facts: DataFrame) -> DataFrame:
    """Directed flows per run and good; returned lines travel customer -> supplier.

    Every fact feeds the result run and, if shipped before the cutoff, the
    baseline run: one pass for both runs, and no shuffle where the facts are stored by pair.
    """
    stored_pair = [c for c in PAIR if c in facts.columns]
    returned = F.col("returned")
    runs = F.when(F.col("early"), F.array(F.lit(RUN_BASELINE), F.lit(RUN_RESULT))).otherwise(
        F.array(F.lit(RUN_RESULT)))
    return (facts.select(
        F.explode(runs).alias("run_id"),
        F.when(returned, F.col("cust_node")).otherwise(F.col("supp_node")).alias("src"),
        F.when(returned, F.col("supp_node")).otherwise(F.col("cust_node")).alias("dst"),
        "good", "q", *stored_pair)
        .groupBy("run_id", "src", "dst", "good", *stored_pair).agg(F.sum("q").alias("q"))
        .select("run_id", "src", "dst", "good", "q", *stored_pair))


def build_trade_edges(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    lines = trade_fact_lines(spark, sf_dir) if lines is None else lines
    return edges_from_facts(trade_line_facts(lines))


def build_trade_arc_flow(spark: SparkSession, sf_dir: str,
                         lines: DataFrame | None = None) -> DataFrame:
    lines = trade_fact_lines(spark, sf_dir) if lines is None else lines
    return flow_from_facts(trade_line_facts(lines))


def trade_arc_infra(edges: DataFrame) -> DataFrame:
    """Infrastructure per run and direction: baseline keeps Ijk, result scales by src."""
    stored_pair = [c for c in PAIR if c in edges.columns]
    arcs = to_arcs(edges.select("from", "to", "Ijk", *stored_pair))
    scale = F.lit(1.0) + (F.col("src") % 4) / F.lit(10)
    runs = F.array(
        F.struct(F.lit(RUN_BASELINE).alias("run_id"), F.col("Ijk").alias("ijk")),
        F.struct(F.lit(RUN_RESULT).alias("run_id"), (F.col("Ijk") * scale).alias("ijk")))
    return arcs.select("src", "dst", F.inline(runs), *stored_pair).select("run_id", "src", "dst", "ijk", *stored_pair)


def trade_node_output(arc_flow: DataFrame) -> DataFrame:
    return arc_flow.groupBy("run_id", F.col("src").alias("node"), "good").agg(
        F.sum("q").alias("y"))


def trade_node_alloc(nodes: DataFrame, arc_flow: DataFrame,
                     params: dict | None = None) -> DataFrame:
    """Per-node outcomes: CES of incoming flow, per-capita consumption, utility, price index."""
    p = dict(TRADE_PARAMS, **(params or {}))
    e = (p["sigma"] - 1.0) / p["sigma"]
    per_good = arc_flow.groupBy("run_id", F.col("dst").alias("node"), "good").agg(
        F.sum("q").alias("c"))
    ces = per_good.groupBy("run_id", "node").agg(
        F.pow(F.sum(F.pow("c", F.lit(e))), F.lit(1.0 / e)).alias("c_agg"))
    h = F.lit(1.0 - p["alpha"])  # housing fallback per capita: H/L = 1 - alpha
    grid = nodes.select("node", "population",
                        F.explode(F.array(F.lit(RUN_BASELINE), F.lit(RUN_RESULT))).alias("run_id"))
    out = grid.join(ces, ["run_id", "node"], "left")
    c_pc = F.col("c_agg") / F.col("population")
    return out.select(
        "run_id", "node",
        utility(c_pc, h, F.lit(p["alpha"]), F.lit(p["rho"])).alias("uj"),
        c_pc.alias("c_pc"),
        F.col("c_agg"),
        (F.lit(1.0) + (F.col("node") % 50) / F.lit(100)).alias("PCj"),
        F.col("population").alias("Lj"))


# ---------------------------------------------------------------- stored fixture tables
#
# The network and the allocations are inputs of every result query (uploaded
# tables and solver outputs in the reference), so they are derived once per
# session and stored as Parquet in the shared checkpoint folder; queries then
# read them like any stored table (column pruning and filter pushdown apply).

_STORE: dict[tuple[str, str], str] = {}
STORED = ("nodes", "edges", "arc_flow", "arc_infra", "node_alloc", "node_output")
BUCKETED = ("line_facts", "edges", "arc_flow", "arc_infra")  # stored by the canonical pair


def _bucketed(base: str, name: str) -> str:
    return base.rsplit("/", 1)[-1].replace("-", "_") + "_" + name


def fixture_store(spark: SparkSession, sf_dir: str) -> str:
    """Folder holding the derived NET-T tables for ``sf_dir`` (built on first use)."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key in _STORE:
        return _STORE[key]
    base = scratch_dir(spark, "trade-network")
    build_trade_nodes(spark, sf_dir).write.mode("overwrite").parquet(f"{base}/nodes")
    nodes = spark.read.parquet(f"{base}/nodes")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def store(df: DataFrame, name: str) -> DataFrame:
        return write_dealt(df, _bucketed(base, name), f"{base}/{name}", buckets)

    # One pass over lineitem ⋈ orders: the aggregated facts (at most 20 a pair) are dealt by pair once, and all
    # tables by pair are derived from them where they lie; only the numbering of the edges shuffles again, four longs a row.
    facts = store(deal_by_pair(trade_line_facts(trade_fact_lines(spark, sf_dir)), buckets, "supp_node", "cust_node"),
                  "line_facts")
    edges = store(edge_columns(deal_by_pair(numbered_pairs(facts), buckets, "from", "to")), "edges")
    flow = store(flow_from_facts(facts), "arc_flow")
    store(trade_arc_infra(edges), "arc_infra")
    trade_node_alloc(nodes, flow).write.mode("overwrite").parquet(f"{base}/node_alloc")
    trade_node_output(flow).write.mode("overwrite").parquet(f"{base}/node_output")
    _STORE[key] = base
    return base


def stored(spark: SparkSession, sf_dir: str, name: str, paired: bool = False) -> DataFrame:
    """A stored table; with ``paired`` those of ``BUCKETED`` keep their pair columns and their buckets."""
    base = fixture_store(spark, sf_dir)
    if name not in BUCKETED:
        return spark.read.parquet(f"{base}/{name}")
    return spark.table(_bucketed(base, name)) if paired else spark.read.parquet(f"{base}/{name}").drop(*PAIR)


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NET-T nodes (stored)."""
    return stored(spark, sf_dir, "nodes")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NET-T edges (stored)."""
    return stored(spark, sf_dir, "edges")


def trade_arc_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NET-T directed flows per run and good (stored)."""
    return stored(spark, sf_dir, "arc_flow")


def trade_network(spark: SparkSession, sf_dir: str, paired: bool = False) -> NetworkTables:
    return NetworkTables(trade_nodes(spark, sf_dir), stored(spark, sf_dir, "edges", paired))


def trade_allocations(spark: SparkSession, sf_dir: str,
                      net: NetworkTables | None = None, paired: bool = False) -> Allocations:
    """The four allocation tables of the two runs (stored); ``paired``: arcs by pair, in buckets."""
    return Allocations(arc_infra=stored(spark, sf_dir, "arc_infra", paired),
                       arc_flow=stored(spark, sf_dir, "arc_flow", paired),
                       node_alloc=stored(spark, sf_dir, "node_alloc"),
                       node_output=stored(spark, sf_dir, "node_output"))
