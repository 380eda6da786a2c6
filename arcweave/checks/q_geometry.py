"""Registered queries: geometry, joins, features, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcweave.checks import sql_variants as SV
from arcweave.checks import sqlparts as S
from arcweave.checks.q_results import F1_DOUBLES, F2_DOUBLES, _f2_sql
from arcweave.checks.registry import register, small_blocks
from arcweave.functions import (curved_line, haversine_km, iceberg_cost, parse_linestring,
                                to_linestring)
from arcweave.operators.aggregates import bounding_box
from arcweave.operators.joins import attach_geometry, resolve_geometry, with_endpoints
from arcweave.plans.publish import edge_features, node_features
from arcweave.plans.results import edge_table, network_cap, node_table
from arcweave.session import scratch_dir
from arcweave.plans.validation import type_network
from arcweave.sources import files as IO
from arcweave.sources import fixtures as X
from arcweave.sources import variants as VA

CTES = S.NET_T + SV.VARIANTS
PL = S.parse_line("geometry")


def _line_summary(line):
    return [F.size(line).cast("bigint").alias("n_points"),
            line[0]["lon"].alias("lon_first"), line[0]["lat"].alias("lat_first"),
            F.element_at(line, -1)["lon"].alias("lon_last"),
            F.element_at(line, -1)["lat"].alias("lat_last")]


def _line_summary_sql(pl: str) -> str:
    return (f"CAST(len({pl}) AS BIGINT) AS n_points, {pl}[1].lon AS lon_first, "
            f"{pl}[1].lat AS lat_first, {pl}[-1].lon AS lon_last, {pl}[-1].lat AS lat_last")


LINE_DOUBLES = ("lon_first", "lat_first", "lon_last", "lat_last")


@register("c1_parse_linestring", f"SELECT edge_id, {_line_summary_sql(PL)} FROM tedges",
          LINE_DOUBLES)
def c1_parse_linestring(spark, sf_dir):
    e = X.trade_edges(spark, sf_dir)
    return e.select("edge_id", *_line_summary(parse_linestring("geometry")))


def _offset_sql():
    return '((("from" * 7 + "to") % 11 - 5) / 100)'


def _curved_sql():
    lf, af, lt, at = S.lon('"from"'), S.lat('"from"'), S.lon('"to"'), S.lat('"to"')
    mx, my = f"(({lf}) + ({lt})) / 2", f"(({af}) + ({at})) / 2"
    dx, dy = f"(({lt}) - ({lf}))", f"(({at}) - ({af}))"
    nrm = f"greatest(sqrt({dx} * {dx} + {dy} * {dy}), 1e-9)"
    px = f"round({mx} - {_offset_sql()} * {dy} / {nrm}, 4)"
    py = f"round({my} + {_offset_sql()} * {dx} / {nrm}, 4)"

    def pt(x, y):
        return f"{S.plain(x)} || ' ' || {S.plain(y)}"
    return (f"SELECT edge_id, 'LINESTRING (' || {pt(lf, af)} || ', ' || {pt(px, py)} || ', ' || "
            f"{pt(lt, at)} || ')' AS wkt FROM tedges")


@register("c2_to_linestring", _curved_sql())
def c2_to_linestring(spark, sf_dir):
    e = X.trade_edges(spark, sf_dir)
    f, t = F.col("from"), F.col("to")
    off = ((f * 7 + t) % 11 - 5) / F.lit(100)
    line = curved_line(X.node_lon(f), X.node_lat(f), X.node_lon(t), X.node_lat(t), off)
    return e.select("edge_id", to_linestring(line).alias("wkt"))


@register("c3_haversine_km", f"SELECT edge_id, "
          f"{S.hav(S.lon(chr(34)+'from'+chr(34)), S.lat(chr(34)+'from'+chr(34)), S.lon(chr(34)+'to'+chr(34)), S.lat(chr(34)+'to'+chr(34)))} "
          f"AS km FROM tedges", ("km",))
def c3_haversine_km(spark, sf_dir):
    e = X.trade_edges(spark, sf_dir)
    f, t = F.col("from"), F.col("to")
    return e.select("edge_id", haversine_km(X.node_lon(f), X.node_lat(f), X.node_lon(t),
                                            X.node_lat(t)).alias("km"))


def _c4_sql():
    km = S.hav(S.lon('"from"'), S.lat('"from"'), S.lon('"to"'), S.lat('"to"'))
    return f"SELECT edge_id, {S.iceberg(km, 0.0)} AS delta_tau FROM nedges"


@register("c4_iceberg_cost", _c4_sql(), ("delta_tau",), ctes=S.NET_T + SV.NATION)
def c4_iceberg_cost(spark, sf_dir):
    e = VA.nation_network(spark, sf_dir).edges
    f, t = F.col("from"), F.col("to")
    km = haversine_km(X.node_lon(f), X.node_lat(f), X.node_lon(t), X.node_lat(t))
    return e.select("edge_id", iceberg_cost(km, 0.0).alias("delta_tau"))


@register("d1_with_endpoints", """
    SELECT e.edge_id, a.lon AS lon_from, a.lat AS lat_from, b.lon AS lon_to, b.lat AS lat_to
    FROM tedges e LEFT JOIN vorphan_nodes a ON a.node = e."from"
    LEFT JOIN vorphan_nodes b ON b.node = e."to" """,
          ("lon_from", "lat_from", "lon_to", "lat_to"), ctes=CTES)
def d1_with_endpoints(spark, sf_dir):
    net = VA.orphan_variant(spark, sf_dir)
    return with_endpoints(net.edges.select("edge_id", "from", "to"), net.nodes).select(
        "edge_id", "lon_from", "lat_from", "lon_to", "lat_to")


def _d2_sql():
    straight = ("CASE WHEN a.lon IS NOT NULL AND a.lat IS NOT NULL AND b.lon IS NOT NULL AND "
                "b.lat IS NOT NULL THEN [{'lon': a.lon, 'lat': a.lat}, "
                "{'lon': b.lon, 'lat': b.lat}] END")
    line = f"coalesce({S.parse_line('e.geometry')}, {straight})"
    return f"""SELECT edge_id, {_line_summary_sql('line')} FROM (
        SELECT e.edge_id, {line} AS line FROM tedges e
        LEFT JOIN vorphan_nodes a ON a.node = e."from"
        LEFT JOIN vorphan_nodes b ON b.node = e."to") q WHERE line IS NOT NULL"""


@register("d2_resolve_geometry", _d2_sql(), LINE_DOUBLES, ctes=CTES)
def d2_resolve_geometry(spark, sf_dir):
    net = VA.orphan_variant(spark, sf_dir)
    r = resolve_geometry(net.edges.select("edge_id", "from", "to", "geometry"), net.nodes)
    return r.select("edge_id", *_line_summary(F.col("line")))


@register("d3_attach_geometry", """
    SELECT e.edge_id, g.geometry FROM tedges e LEFT JOIN (
      SELECT "from", "to", min(geometry) AS geometry FROM tedges WHERE ("from" + "to") % 17 <> 0
      GROUP BY "from", "to") g ON g."from" = e."from" AND g."to" = e."to" """)
def d3_attach_geometry(spark, sf_dir):
    e = X.trade_edges(spark, sf_dir)
    geom = e.filter((F.col("from") + F.col("to")) % 17 != 0).select("from", "to", "geometry")
    joined, _ = attach_geometry(e.select("edge_id", "from", "to"), geom)
    return joined.select("edge_id", "geometry")


@register("d3_missing_geometry", """
    SELECT 'error' AS severity, 'D3' AS rule, 'edges' AS entity, edge_id AS key,
           'no geometry for ' || CAST("from" AS VARCHAR) || '/' || CAST("to" AS VARCHAR) AS message
    FROM tedges WHERE ("from" + "to") % 17 = 0""")
def d3_missing_geometry(spark, sf_dir):
    e = X.trade_edges(spark, sf_dir)
    geom = e.filter((F.col("from") + F.col("to")) % 17 != 0).select("from", "to", "geometry")
    _, findings = attach_geometry(e.select("edge_id", "from", "to"), geom)
    return findings


@register("d3_duplicate_geometry", """
    SELECT 'warning' AS severity, 'D3' AS rule, 'edges' AS entity, edge_id AS key,
           '2 geometries for ' || CAST("from" AS VARCHAR) || '/' || CAST("to" AS VARCHAR) AS message
    FROM tedges WHERE ("from" + "to") % 19 = 0""")
def d3_duplicate_geometry(spark, sf_dir):
    e = X.trade_edges(spark, sf_dir)
    geom = e.select("from", "to", "geometry")
    again = e.filter((F.col("from") + F.col("to")) % 19 == 0).select("from", "to", F.lit("x").alias("geometry"))
    return attach_geometry(e.select("edge_id", "from", "to"), geom.unionByName(again))[1]


def _f1_with_line(spark, sf_dir):
    """F1 and the line of each edge, found where the edges are stored by pair; the cap is that of all edges."""
    net = X.trade_network(spark, sf_dir, paired=True)
    alloc = X.trade_allocations(spark, sf_dir, net, paired=True)
    lined = resolve_geometry(net.edges, net.nodes.select("node", "lon", "lat"), undrawn=True)
    cap = network_cap(net.edges, alloc.arc_infra.filter(F.col("run_id") == "result"))
    return edge_table(X.NetworkTables(net.nodes, lined), alloc.arc_infra, alloc.arc_flow, "result",
                      X.N_GOODS_FROM_PARTS, keep=("line",), cap=cap)


@register("a6_edge_features", """
    SELECT e."from", e."to", 'LineString' AS geom_type,
           CAST(coalesce(len(""" + PL.replace("geometry", "e.geometry") + """), 2) AS BIGINT)
             AS n_coords,
           CAST(14 AS BIGINT) AS n_props
    FROM tedges e""")
def a6_edge_features(spark, sf_dir):
    feats = edge_features(_f1_with_line(spark, sf_dir))
    j = F.col("feature")
    return feats.select(
        "from", "to", F.get_json_object(j, "$.geometry.type").alias("geom_type"),
        F.json_array_length(F.get_json_object(j, "$.geometry.coordinates")).cast("bigint").alias(
            "n_coords"),
        F.size(F.json_object_keys(F.get_json_object(j, "$.properties"))).cast("bigint").alias(
            "n_props"))


@register("a6_edge_feature_values", f"""
    SELECT "from", "to", {S.round_sig('Ijk', 7)} AS Ijk, {S.round_sig('Qjk_total', 7)} AS Qjk_total
    FROM ({S.edge_table('result')[1]}) f1""", ("Ijk", "Qjk_total"),
          ctes=S.NET_T + S.edge_table("result")[0])
def a6_edge_feature_values(spark, sf_dir):
    feats = edge_features(_f1_with_line(spark, sf_dir))
    j = F.col("feature")
    return feats.select(
        "from", "to",
        F.get_json_object(j, "$.properties.Ijk").cast("double").alias("Ijk"),
        F.get_json_object(j, "$.properties.Qjk_total").cast("double").alias("Qjk_total"))


@register("a7_node_features", """
    SELECT node, 'Point' AS geom_type, lon, lat, name FROM tnodes""", ("lon", "lat"))
def a7_node_features(spark, sf_dir):
    nodes = X.trade_nodes(spark, sf_dir).drop("nationkey")
    j = F.col("feature")
    return node_features(nodes).select(
        "node", F.get_json_object(j, "$.geometry.type").alias("geom_type"),
        F.get_json_object(j, "$.geometry.coordinates[0]").cast("double").alias("lon"),
        F.get_json_object(j, "$.geometry.coordinates[1]").cast("double").alias("lat"),
        F.get_json_object(j, "$.properties.name").alias("name"))


@register("e17_bounding_box", """
    SELECT min(lon) - (max(lon) - min(lon)) * 0.15 AS min_lon,
           min(lat) - (max(lat) - min(lat)) * 0.15 AS min_lat,
           max(lon) + (max(lon) - min(lon)) * 0.15 AS max_lon,
           max(lat) + (max(lat) - min(lat)) * 0.15 AS max_lat, count(*) AS n_points
    FROM tnodes""", ("min_lon", "min_lat", "max_lon", "max_lat"))
def e17_bounding_box(spark, sf_dir):
    return bounding_box(X.trade_nodes(spark, sf_dir))


@register("e17_bounding_box_edges", f"""
    SELECT min(p.lon) - (max(p.lon) - min(p.lon)) * 0.15 AS min_lon,
           min(p.lat) - (max(p.lat) - min(p.lat)) * 0.15 AS min_lat,
           max(p.lon) + (max(p.lon) - min(p.lon)) * 0.15 AS max_lon,
           max(p.lat) + (max(p.lat) - min(p.lat)) * 0.15 AS max_lat, count(*) AS n_points
    FROM (SELECT unnest({PL}) AS p FROM tedges) u""",
          ("min_lon", "min_lat", "max_lon", "max_lat"))
def e17_bounding_box_edges(spark, sf_dir):
    return bounding_box(None, X.trade_edges(spark, sf_dir).select(parse_linestring("geometry").alias("line")))


@register("a1_a3_csv_roundtrip", """
    SELECT node, lon, lat, population, productivity, product, name FROM tnodes""",
          ("lon", "lat", "population", "productivity"))
def a1_a3_csv_roundtrip(spark, sf_dir):
    net = X.trade_network(spark, sf_dir)
    out = scratch_dir(spark, "network-csv")
    net.nodes.drop("nationkey").write.mode("overwrite").option("header", True).csv(
        f"{out}/nodes.csv")
    net.edges.write.mode("overwrite").option("header", True).csv(f"{out}/edges.csv")
    loaded = IO.load_network(spark, out, "csv")
    typed, _ = type_network(loaded, raw=True)
    return typed.nodes.select("node", "lon", "lat", "population", "productivity",
                              F.col("product").cast("int"), "name")


@register("a2_csv_edges_roundtrip", 'SELECT edge_id, "from", "to", Ijk, Il, Iu, geometry '
                                    'FROM tedges', ("Ijk", "Il", "Iu"))
def a2_csv_edges_roundtrip(spark, sf_dir):
    net = X.trade_network(spark, sf_dir)
    out = scratch_dir(spark, "edges-csv")
    net.edges.write.mode("overwrite").option("header", True).csv(out)
    raw = IO.read_edges(spark, out, "csv")
    typed, _ = type_network(X.NetworkTables(None, raw), raw=True)
    return typed.edges.select(F.col("edge_id").cast("long"), "from", "to", "Ijk", "Il", "Iu",
                              "geometry")


@register("a2_csv_edge_ids", 'SELECT edge_id, "from", "to", Ijk, geometry FROM tedges', ("Ijk",))
def a2_csv_edge_ids(spark, sf_dir):
    """CSV files without ``edge_id``, read in small blocks: the row's number over all files."""
    out = scratch_dir(spark, "edges-csv")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (X.trade_edges(spark, sf_dir).repartitionByRange(files, "edge_id").sortWithinPartitions("edge_id").drop("edge_id")
     .write.option("header", True).option("quote", '"').option("escape", '"').csv(out))
    with small_blocks(spark, out, 256 << 10):
        raw = IO.read_edges(spark, out, "csv")
    typed, _ = type_network(X.NetworkTables(None, raw), raw=True)
    return typed.edges.select("edge_id", "from", "to", "Ijk", "geometry")


def _read_back(spark, written, path):
    """A CSV table with the columns and types of ``written``."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in written.schema.fields])


@register("a5_write_results", f"SELECT * FROM ({S.edge_table('result')[1]}) f1", F1_DOUBLES,
          ctes=S.NET_T + S.edge_table("result")[0])
def a5_write_results(spark, sf_dir):
    net = X.trade_network(spark, sf_dir, paired=True)
    alloc = X.trade_allocations(spark, sf_dir, net, paired=True)
    edges = edge_table(net, alloc.arc_infra, alloc.arc_flow, "result", X.N_GOODS_FROM_PARTS)
    out = scratch_dir(spark, "results")
    IO.write_results(None, edges, out, "csv")
    return _read_back(spark, edges, f"{out}/edges_results")


@register("a5_write_node_results", _f2_sql(), F2_DOUBLES)
def a5_write_node_results(spark, sf_dir):
    net = X.trade_network(spark, sf_dir)
    alloc = X.trade_allocations(spark, sf_dir, net)
    nodes = node_table(X.NetworkTables(net.nodes.drop("nationkey"), net.edges), alloc.node_alloc, alloc.node_output)
    out = scratch_dir(spark, "results")
    IO.write_results(nodes, None, out, "csv")
    return _read_back(spark, nodes, f"{out}/nodes_results")


@register("a6_write_features", f"""
    SELECT CAST("from" AS BIGINT) AS "from", CAST("to" AS BIGINT) AS "to",
           {S.round_sig('Ijk', 7)} AS Ijk FROM ({S.edge_table('result')[1]}) f1""", ("Ijk",),
          ctes=S.NET_T + S.edge_table("result")[0])
def a6_write_features(spark, sf_dir):
    """Features written as text and read back; ids are exact."""
    out = scratch_dir(spark, "features")
    IO.write_lines(edge_features(_f1_with_line(spark, sf_dir)), out)
    prop = lambda k: F.get_json_object("value", f"$.properties.{k}")
    return spark.read.text(out).select(prop("from").cast("long").alias("from"),
                                       prop("to").cast("long").alias("to"),
                                       prop("Ijk").cast("double").alias("Ijk"))
