"""Dirty and derived variants of the trade network (FIXTURES.md section 4) and the run log.

Each variant changes NET-T by a rule on the ids, so it scales with the data and
the SQL oracle can build the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions import fixed_point_text, haversine_km, iceberg_cost
from arcweave.operators.arcs import PAIR
from arcweave.operators.windows import number_within, sequence_number
from arcweave.sources.fixtures import (DELTA_TAU_FLOOR, NetworkTables, edge_geometry_text,
                                       node_lat, node_lon, read_table, stored, supplier_count,
                                       trade_edges, trade_lines, trade_nodes)


def _s():
    return F.col("from") + F.col("to")


def _txt(c):
    return c.cast("string")


def range_variant(spark: SparkSession, sf_dir: str) -> NetworkTables:
    """RANGE: coordinates, signs and zero population broken on a modulus."""
    n = trade_nodes(spark, sf_dir)
    node = F.col("node")
    n = (n.withColumn("lon", F.when(node % 17 == 0, F.col("lon") + 200).otherwise(F.col("lon")))
         .withColumn("productivity", F.when(node % 19 == 0, -F.col("productivity"))
                     .otherwise(F.col("productivity")))
         .withColumn("population", F.when(node % 23 == 0, F.lit(0.0))
                     .otherwise(F.col("population"))))
    e = trade_edges(spark, sf_dir).withColumn(
        "delta_i", F.when(_s() % 29 == 0, -F.col("delta_i")).otherwise(F.col("delta_i")))
    return NetworkTables(n, e)


def bounds_variant(spark: SparkSession, sf_dir: str) -> NetworkTables:
    """BOUNDS: ``Il = Ijk + 1`` and ``Iu = Ijk − 1`` on a modulus."""
    e = trade_edges(spark, sf_dir)
    e = (e.withColumn("Il", F.when(_s() % 3 == 0, F.col("Ijk") + 1).otherwise(F.col("Il")))
         .withColumn("Iu", F.when(_s() % 4 == 0, F.col("Ijk") - 1).otherwise(F.col("Iu"))))
    return NetworkTables(trade_nodes(spark, sf_dir), e)


def bounded_variant(spark: SparkSession, sf_dir: str) -> NetworkTables:
    """BOUNDED: ``Iu = 100`` on every edge."""
    e = trade_edges(spark, sf_dir).withColumn("Iu", F.lit(100.0))
    return NetworkTables(trade_nodes(spark, sf_dir), e)


def orphan_variant(spark: SparkSession, sf_dir: str) -> NetworkTables:
    """ORPHAN: nodes with ``node % 97 = 0`` removed; their edges stay."""
    n = trade_nodes(spark, sf_dir).filter(F.col("node") % 97 != 0)
    return NetworkTables(n, trade_edges(spark, sf_dir))


def types_variant(spark: SparkSession, sf_dir: str) -> NetworkTables:
    """TYPES: every column as text, with bad values on a modulus."""
    n = trade_nodes(spark, sf_dir)
    node = F.col("node")
    raw_n = n.select(
        F.when(node % 7 == 0, F.concat(_txt(node), F.lit(".0"))).otherwise(_txt(node)).alias("node"),
        F.when(node % 31 == 0, F.lit("")).otherwise(_txt(F.col("lon"))).alias("lon"),
        _txt(F.col("lat")).alias("lat"),
        _txt(F.col("population")).alias("population"),
        F.when(node % 13 == 0, F.lit("x")).when(node % 13 == 1, F.lit("5d"))
        .when(node % 13 == 2, F.lit("1.5f")).otherwise(_txt(F.col("productivity"))).alias(
            "productivity"),
        F.when(node % 11 == 0, F.lit("3.7")).when(node % 11 == 1, F.lit("9007199254740993"))
        .when(node % 11 == 2, F.lit("3.0")).otherwise(_txt(F.col("product"))).alias("product"),
        F.col("name"))
    e = trade_edges(spark, sf_dir)
    raw_e = e.select(
        "edge_id",
        F.when(_s() % 3 == 0, F.concat(_txt(F.col("from")), F.lit(".0"))).otherwise(
            _txt(F.col("from"))).alias("from"),
        F.when(_s() % 43 == 0, F.concat(_txt(F.col("to")), F.lit(".5"))).otherwise(
            _txt(F.col("to"))).alias("to"),
        _txt(F.col("delta_i")).alias("delta_i"),
        F.when(_s() % 37 == 0, F.lit("x")).otherwise(_txt(F.col("delta_tau"))).alias("delta_tau"),
        F.when(_s() % 41 == 0, F.lit("")).otherwise(_txt(F.col("Ijk"))).alias("Ijk"),
        _txt(F.col("Il")).alias("Il"),
        F.when(_s() % 47 == 0, F.lit("x")).otherwise(_txt(F.col("Iu"))).alias("Iu"),
        F.col("geometry"))
    return NetworkTables(raw_n, raw_e)


def nan_variant(spark: SparkSession, sf_dir: str) -> NetworkTables:
    """NAN: 'NaN' and 'Inf' texts in required columns and in ``Iu``."""
    n = trade_nodes(spark, sf_dir)
    node = F.col("node")
    raw_n = n.select(
        _txt(node).alias("node"),
        F.when(node % 29 == 0, F.lit("NaN")).otherwise(_txt(F.col("lon"))).alias("lon"),
        _txt(F.col("lat")).alias("lat"),
        _txt(F.col("population")).alias("population"),
        F.when(node % 37 == 0, F.lit("Inf")).otherwise(_txt(F.col("productivity"))).alias(
            "productivity"),
        _txt(F.col("product")).alias("product"))
    e = trade_edges(spark, sf_dir)
    raw_e = e.select(
        "edge_id", _txt(F.col("from")).alias("from"), _txt(F.col("to")).alias("to"),
        F.when(_s() % 43 == 0, F.lit("NaN")).otherwise(_txt(F.col("delta_i"))).alias("delta_i"),
        _txt(F.col("delta_tau")).alias("delta_tau"), _txt(F.col("Ijk")).alias("Ijk"),
        _txt(F.col("Il")).alias("Il"),
        F.when(_s() % 19 == 0, F.lit("Inf")).otherwise(_txt(F.col("Iu"))).alias("Iu"))
    return NetworkTables(raw_n, raw_e)


def dup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP: one edge per shipped line; ``edge_id`` = position in line-key order.

    Returned lines are listed customer -> supplier, so reversed duplicates occur too.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_returnflag")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = (li.join(orders, li.l_orderkey == orders.o_orderkey)
             .crossJoin(F.broadcast(supplier_count(spark, sf_dir))))
    supp = (F.col("l_suppkey") + 1).cast("long")
    cust = (F.col("n_sup") + F.col("o_custkey") + 1).cast("long")
    r = F.col("l_returnflag") == "R"
    lines = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.when(r, cust).otherwise(supp).alias("from"),
        F.when(r, supp).otherwise(cust).alias("to"), "l_quantity")
    numbered = sequence_number(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                       "l_shipdate"], "edge_id")
    f, t = F.col("from"), F.col("to")
    km = haversine_km(node_lon(f), node_lat(f), node_lon(t), node_lat(t))
    ijk = (F.lit(20) + F.floor(F.col("l_quantity")) % F.lit(61)).cast("double")
    return numbered.select(
        "edge_id", "from", "to",
        (F.lit(1.0) + ((f * 31 + t) % 97) / F.lit(10)).alias("delta_i"),
        iceberg_cost(km, DELTA_TAU_FLOOR).alias("delta_tau"),
        ijk.alias("Ijk"))


def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NET-N flow lines: nation of supplier -> nation of customer (ids ``n_nationkey + 1``)."""
    lines = trade_lines(spark, sf_dir)
    nodes = trade_nodes(spark, sf_dir).select("node", "nationkey")
    a = nodes.select(F.col("node").alias("supp_node"), F.col("nationkey").alias("ns"))
    b = nodes.select(F.col("node").alias("cust_node"), F.col("nationkey").alias("nc"))
    return (lines.join(a, "supp_node").join(b, "cust_node")
            .select((F.col("ns") + 1).cast("long").alias("src"),
                    (F.col("nc") + 1).cast("long").alias("dst"),
                    (F.col("l_partkey") % 5 + 1).cast("int").alias("good"), "l_quantity"))


def nation_network(spark: SparkSession, sf_dir: str) -> NetworkTables:
    """LOOP / NET-N: 25 nation nodes; one edge per distinct unordered nation pair, self-pairs kept."""
    nation = read_table(spark, sf_dir, "nation")
    nodes = nation.select((F.col("n_nationkey") + 1).cast("long").alias("node"),
                          node_lon(F.col("n_nationkey") + 1).alias("lon"),
                          node_lat(F.col("n_nationkey") + 1).alias("lat"),
                          F.lit(1.0).alias("population"), F.lit(1.0).alias("productivity"),
                          (F.col("n_regionkey") + 1).cast("int").alias("product"),
                          F.col("n_name").alias("name"))
    pairs = (nation_lines(spark, sf_dir)
             .groupBy(F.least("src", "dst").alias("from"), F.greatest("src", "dst").alias("to"))
             .agg(F.sum("l_quantity").alias("qty")))
    f, t = F.col("from"), F.col("to")
    edges = pairs.select(
        (f * F.lit(1 << 32) + t).alias("edge_id"), "from", "to",
        F.lit(1.0).alias("delta_i"), F.lit(0.1).alias("delta_tau"),
        (F.lit(20) + F.floor(F.col("qty")) % F.lit(61)).cast("double").alias("Ijk"))
    return NetworkTables(nodes, edges)


def nation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NET-N arc flows with the natural self-flows: ``(src, dst, good, q)``."""
    return nation_lines(spark, sf_dir).groupBy("src", "dst", "good").agg(
        F.sum("l_quantity").alias("q"))


def domestic_network(spark: SparkSession, sf_dir: str) -> NetworkTables:
    """NET-D: NET-T edges whose endpoints share a nation; all NET-T nodes."""
    nodes = trade_nodes(spark, sf_dir)
    edges = trade_edges(spark, sf_dir)
    a = nodes.select(F.col("node").alias("from"), F.col("nationkey").alias("nf"))
    b = nodes.select(F.col("node").alias("to"), F.col("nationkey").alias("nt"))
    dom = (edges.join(a, "from").join(b, "to").filter(F.col("nf") == F.col("nt"))
           .drop("nf", "nt"))
    return NetworkTables(nodes, dom)


# ---------------------------------------------------------------- run log


def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUNLOG: solver-log lines from ``events`` as ``(run_id, event_id, line)``.

    ``error`` events become progress lines numbered per run, ``purchase`` a
    finished line; clicks and views over a threshold become abort / failure lines.
    """
    ev = read_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("run_id"), "event_id", "event_type", "value")
    hundredths = F.round(F.col("value") * 100).cast("long")
    tenths = F.round(F.col("value") * 10).cast("long")
    errors = number_within(ev.filter(F.col("event_type") == "error"), ["run_id"], ["event_id"],
                           out="n")
    progress = errors.select(
        "run_id", "event_id",
        F.concat(F.lit("Iteration No. "), _txt(F.col("n")), F.lit(" distance="),
                 fixed_point_text(hundredths, 2), F.lit(" duration="),
                 fixed_point_text(tenths, 1), F.lit(" secs. Welfare="),
                 fixed_point_text(-hundredths, 2)).alias("line"))
    t = F.col("event_type")
    v = F.col("value")
    other = ev.filter(t != "error").select(
        "run_id", "event_id",
        F.when(t == "purchase", F.concat(F.lit("[app] Solve finished in "),
                                         fixed_point_text(tenths, 1), F.lit(" s.")))
        .when((t == "click") & (v > 300), F.lit("[app] Abort requested (event)"))
        .when((t == "view") & (v > 300), F.concat(F.lit("[app] Solve FAILED after "),
                                                  fixed_point_text(tenths, 1), F.lit(" s.")))
        .when(t == "signup", F.concat(F.lit("[app] Building model: "), _txt(F.col("run_id"))))
        .otherwise(F.lit("free text")).alias("line"))
    return progress.unionByName(other)


def geometry_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEOM: NET-T edges as is (LINESTRING, POINT and null geometries)."""
    return trade_edges(spark, sf_dir).select("edge_id", "from", "to", "geometry")


__all__ = ["bounded_variant", "bounds_variant", "domestic_network", "dup_edges",
           "edge_geometry_text", "geometry_edges", "nan_variant", "nation_flow",
           "nation_network", "orphan_variant", "range_variant", "run_log_lines", "types_variant"]


# ---------------------------------------------------------------- raw ETL inputs and scenarios


def raw_tables(spark: SparkSession, sf_dir: str, paired: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw node, edge and geometry tables in source units, built from NET-T (``paired``: by pair, in its buckets).

    Zero population every 5th node, port outflows every 7th, zero durations
    (infinite speed) when ``(from + to) % 53 = 0``, and no geometry when
    ``(from + to) % 17 = 0``.
    """
    n = trade_nodes(spark, sf_dir)
    node = F.col("node")
    raw_nodes = n.select(
        node.alias("row_order"), "lon", "lat",
        F.when(node % 5 == 0, F.lit(0.0)).otherwise(F.col("population") * 1000).alias(
            "population"),
        (F.col("productivity") * 1e9).alias("gdp"),
        F.when(node % 7 == 0, (node * 10).cast("double")).otherwise(F.lit(0.0)).alias("outflows"),
        "product", F.col("name").alias("city_country"))
    e = stored(spark, sf_dir, "edges", paired)
    pair = [c for c in PAIR if paired]
    f, t = F.col("from"), F.col("to")
    metres = haversine_km(node_lon(f), node_lat(f), node_lon(t), node_lat(t)) * 1000
    minutes = metres / 1000 / F.col("Ijk") * 60
    raw_edges = e.select(
        "edge_id", "from", "to", metres.alias("distance"),
        F.when(_s() % 53 == 0, F.lit(0.0)).otherwise(minutes).alias("duration"),
        (F.col("delta_i") * 1e5).alias("ug_cost_km"), *pair)
    raw_geometry = e.filter(_s() % 17 != 0).select("from", "to", "geometry", *pair)
    return raw_nodes, raw_edges, raw_geometry


def scenario_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario per region, parameters by rule on the region key (exact decimals)."""
    k = F.col("r_regionkey").cast("long")
    return read_table(spark, sf_dir, "region").select(
        (k + 1).alias("scenario_id"),
        ((k + 3) / 10).alias("alpha"), F.lit(1.0).alias("beta"),
        ((k + 8) / 10).alias("gamma"), (k % 3).cast("double").alias("rho"),
        ((k + 1) * 1000).cast("double").alias("K"), (k + 3).cast("double").alias("tol"),
        (k + 2).cast("double").alias("min_iter"), ((k * 10 + 105) / 10).alias("max_iter"),
        (k + 3).cast("double").alias("sigma"), ((k + 7) / 10).alias("a"),
        ((k + 1) / 2).alias("nu"),
        (k == 3).alias("labor_mobility"), (k % 2 == 0).alias("annealing"),
        F.lit(True).alias("duality"), (k % 2 == 1).alias("allow_downgrade"),
        (k < 2).alias("productivity_floor"),
        F.when(k == 4, F.lit("road")).alias("preset"))
