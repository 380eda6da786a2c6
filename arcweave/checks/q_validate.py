"""Registered queries: typing, validation and graph rules (section 2B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcweave.checks import sql_variants as SV
from arcweave.checks.registry import register
from arcweave.checks.sqlparts import NET_T, parse_line
from arcweave.operators import validate as V
from arcweave.operators.graph import connected_components, extend_components
from arcweave.plans.validation import cross_checks, type_network, validate_network
from arcweave.session import ensure_checkpoint_dir
from arcweave.sources import fixtures as X
from arcweave.sources import variants as VA

CTES = NET_T + SV.VARIANTS
PL = parse_line("geometry")
FIND = "SELECT severity, rule, entity, key, message FROM "


@register("b1_require_columns", "SELECT 'error' AS severity, 'B1' AS rule, 'nodes' AS entity, "
          "CAST(NULL AS BIGINT) AS key, 'nodes: absent lat, "
          "population, productivity; needed node, lon, lat, population, productivity' "
          "AS message FROM (SELECT count(*) AS n FROM tnodes) z WHERE n >= 0")
def b1_require_columns(spark, sf_dir):
    nodes = X.trade_nodes(spark, sf_dir).select("node", "lon")
    return V.require_columns(nodes, V.NODE_REQUIRED, "nodes")


def _types_sql():
    n = SV.col_findings("vtypes_nodes", SV.coerce_specs(SV.NODE_COERCE, "nodes"))
    e = SV.col_findings("vtypes_edges", SV.coerce_specs(SV.EDGE_COERCE, "edges"))
    return f"{FIND}{n} a UNION ALL {FIND}{e} b"


@register("b2_b3_coerce_types", _types_sql(), ctes=CTES)
def b2_b3_coerce_types(spark, sf_dir):
    _, findings = type_network(VA.types_variant(spark, sf_dir), raw=True)
    return V.union_findings(findings)


def _typed_types_sql():
    return (f"SELECT node, lon, productivity, product FROM ({SV.typed_nodes('vtypes_nodes')}) t")


@register("b3_typed_nodes", _typed_types_sql(), ("lon", "productivity"), ctes=CTES)
def b3_typed_nodes(spark, sf_dir):
    typed, _ = type_network(VA.types_variant(spark, sf_dir), raw=True)
    return typed.nodes.select("node", "lon", "productivity", "product")


@register("b4_housing_policy", "SELECT 'warning' AS severity, 'B4' AS rule, 'nodes' AS entity, "
          "CAST(NULL AS BIGINT) AS key, 'housing absent, derived from population' "
          "AS message FROM (SELECT count(*) AS n FROM tnodes) z WHERE n > 0")
def b4_housing_policy(spark, sf_dir):
    return V.resolve_housing_policy(X.trade_nodes(spark, sf_dir))


@register("b5_consecutive_ids", """
    SELECT 'error' AS severity, 'B5' AS rule, 'nodes' AS entity, CAST(NULL AS BIGINT) AS key,
           'numbering has holes or repeats: rows ' || CAST(j AS VARCHAR) || ', lowest ' ||
           CAST(lo AS VARCHAR) || ', highest ' || CAST(hi AS VARCHAR) AS message
    FROM (SELECT count(*) AS j, min(node) AS lo, max(node) AS hi, count(DISTINCT node) AS nd
          FROM vorphan_nodes) s
    WHERE j > 0 AND NOT (lo = 1 AND hi = j AND nd = j)""", ctes=CTES)
def b5_consecutive_ids(spark, sf_dir):
    return V.check_consecutive_ids(VA.orphan_variant(spark, sf_dir).nodes)


@register("b6_b8_node_values", f"{FIND}{SV.col_findings('vrange_nodes', SV.node_value_specs())} q",
          ctes=CTES)
def b6_b8_node_values(spark, sf_dir):
    return V.check_node_values(VA.range_variant(spark, sf_dir).nodes)


@register("b9_edge_values", f"{FIND}{SV.col_findings('vrange_edges', SV.edge_value_specs())} q",
          ctes=CTES)
def b9_edge_values(spark, sf_dir):
    return V.check_edge_values(VA.range_variant(spark, sf_dir).edges.drop("geometry"))


def _nan_sql():
    n = SV.col_findings(f"({SV.typed_nodes('vnan_nodes')}) tn", SV.node_value_specs())
    e = SV.col_findings(f"({SV.typed_edges('vnan_edges')}) te", SV.edge_value_specs())
    return f"{FIND}{n} a UNION ALL {FIND}{e} b"


@register("b6_b9_nan_values", _nan_sql(), ctes=CTES)
def b6_b9_nan_values(spark, sf_dir):
    typed, _ = type_network(VA.nan_variant(spark, sf_dir), raw=True)
    return V.check_node_values(typed.nodes).unionByName(V.check_edge_values(typed.edges))


@register("b10_references", """
    SELECT 'error' AS severity, 'B10' AS rule, 'edges' AS entity, edge_id AS key,
           'edge ' || CAST(edge_id AS VARCHAR) || ': unknown endpoint, ' ||
           CAST("from" AS VARCHAR) || ' > ' || CAST("to" AS VARCHAR) AS message
    FROM tedges e
    WHERE NOT EXISTS (SELECT 1 FROM vorphan_nodes n WHERE n.node = e."from")
       OR NOT EXISTS (SELECT 1 FROM vorphan_nodes n WHERE n.node = e."to")""", ctes=CTES)
def b10_references(spark, sf_dir):
    net = VA.orphan_variant(spark, sf_dir)
    return V.check_references(V.reference_flags(net.edges, net.nodes))


@register("b11_self_loops", """
    SELECT 'error' AS severity, 'B11' AS rule, 'edges' AS entity, edge_id AS key,
           'edge ' || CAST(edge_id AS VARCHAR) || ': both ends at ' ||
           CAST("from" AS VARCHAR) AS message
    FROM nedges WHERE "from" = "to" """, ctes=NET_T + SV.NATION)
def b11_self_loops(spark, sf_dir):
    return V.check_self_loops(VA.nation_network(spark, sf_dir).edges)


@register("b12_duplicates", """
    SELECT 'error' AS severity, 'B12' AS rule, 'edges' AS entity, edge_id AS key,
           'edge ' || CAST(edge_id AS VARCHAR) || ' repeats edge ' || CAST(first_id AS VARCHAR) ||
           ' between ' || CAST("from" AS VARCHAR) || ' and ' || CAST("to" AS VARCHAR) AS message
    FROM (SELECT edge_id, "from", "to", min(edge_id) OVER (PARTITION BY least("from", "to"),
                 greatest("from", "to")) AS first_id FROM vdup_edges) d
    WHERE edge_id <> first_id""", ctes=NET_T + SV.DUP)
def b12_duplicates(spark, sf_dir):
    return V.check_duplicates(VA.dup_edges(spark, sf_dir))


@register("b13_bounds", """
    SELECT 'warning' AS severity, 'B13' AS rule, 'edges' AS entity, edge_id AS key,
           'edge ' || CAST(edge_id AS VARCHAR) || ': Il above Ijk, cut to Ijk' AS message
    FROM vbounds_edges WHERE Il > Ijk
    UNION ALL
    SELECT 'warning', 'B13', 'edges', edge_id,
           'edge ' || CAST(edge_id AS VARCHAR) || ': Iu below Ijk, lifted to Ijk'
    FROM vbounds_edges WHERE Iu < Ijk""", ctes=CTES)
def b13_bounds(spark, sf_dir):
    return V.check_bounds(VA.bounds_variant(spark, sf_dir).edges)


@register("b10_b13_cross_checks", """
    SELECT 'error' AS severity, 'B11' AS rule, 'edges' AS entity, edge_id AS key,
           'edge ' || CAST(edge_id AS VARCHAR) || ': both ends at ' ||
           CAST("from" AS VARCHAR) AS message
    FROM nedges WHERE "from" = "to" """, ctes=NET_T + SV.NATION)
def b10_b13_cross_checks(spark, sf_dir):
    net = VA.nation_network(spark, sf_dir)
    return V.union_findings(cross_checks(net.nodes, net.edges))


@register("b15_connected_components", "SELECT node, component FROM dcomp",
          ctes=NET_T + SV.DOMESTIC)
def b15_connected_components(spark, sf_dir):
    net = VA.domestic_network(spark, sf_dir)
    return connected_components(net.nodes, net.edges)


@register("b14_unreachable", """
    SELECT 'warning' AS severity, 'B14' AS rule, 'nodes' AS entity, CAST(NULL AS BIGINT) AS key,
           'nodes without a path to 1: ' || CAST(n AS VARCHAR) AS message
    FROM (SELECT count_if(component <> (SELECT component FROM dcomp WHERE node = 1)) AS n
          FROM dcomp) s WHERE n > 0""", ctes=NET_T + SV.DOMESTIC)
def b14_unreachable(spark, sf_dir):
    net = VA.domestic_network(spark, sf_dir)
    return V.unreachable_finding(connected_components(net.nodes, net.edges))


def _grown_components(spark, sf_dir, steps: int = 3):
    """Nodes without edges, then the edges in ``steps`` parts by a rule on their ids."""
    ensure_checkpoint_dir(spark)
    net = VA.domestic_network(spark, sf_dir)
    now = net.nodes.select("node", F.col("node").alias("component"))
    ends = net.edges.select("from", "to").checkpoint()  # joined with the nodes once, not in every step
    for step in range(steps):
        part = ends.filter((F.col("from") * 7 + F.col("to")) % steps == step)
        now = extend_components(now, part).checkpoint()
    return now


@register("b15_growing_components", "SELECT node, component FROM dcomp", ctes=NET_T + SV.DOMESTIC)
def b15_growing_components(spark, sf_dir):
    """Components after three additions of edges equal those of the whole network."""
    return _grown_components(spark, sf_dir)


@register("b14_unreachable_growing", """
    SELECT 'warning' AS severity, 'B14' AS rule, 'nodes' AS entity, CAST(NULL AS BIGINT) AS key,
           'nodes without a path to 1: ' || CAST(n AS VARCHAR) AS message
    FROM (SELECT count_if(component <> (SELECT component FROM dcomp WHERE node = 1)) AS n
          FROM dcomp) s WHERE n > 0""", ctes=NET_T + SV.DOMESTIC)
def b14_unreachable_growing(spark, sf_dir):
    return V.unreachable_finding(_grown_components(spark, sf_dir))


@register("b15_component_sizes", "SELECT component, count(*) AS n_nodes FROM dcomp "
          "GROUP BY component", ctes=NET_T + SV.DOMESTIC)
def b15_component_sizes(spark, sf_dir):
    from arcweave.operators.graph import component_sizes
    net = VA.domestic_network(spark, sf_dir)
    return component_sizes(connected_components(net.nodes, net.edges))


GEOM_MSG = "geometry unreadable, drawn straight"


@register("b16_geometry", f"""
    SELECT 'warning' AS severity, 'B16' AS rule, 'edges' AS entity, CAST(NULL AS BIGINT) AS key,
           '{GEOM_MSG} (' || CAST(n AS VARCHAR) || ' rows)' AS message
    FROM (SELECT count_if(geometry IS NOT NULL AND {PL} IS NULL) AS n FROM tedges) s WHERE n > 0""")
def b16_geometry(spark, sf_dir):
    return V.check_geometry(X.trade_edges(spark, sf_dir))


def validate_sql(nodes="tnodes", edges="tedges", components="tcomp"):
    """B17 of a network without errors as SQL."""
    node_f = SV.col_findings(nodes, SV.node_value_specs())
    edge_f = SV.col_findings(edges, SV.edge_value_specs())
    return f"""
    SELECT 'warning' AS severity, 'B4' AS rule, 'nodes' AS entity, CAST(NULL AS BIGINT) AS key,
           'housing absent, derived from population' AS message
    UNION ALL {FIND}{node_f} a UNION ALL {FIND}{edge_f} b
    UNION ALL
    SELECT 'warning', 'B16', 'edges', CAST(NULL AS BIGINT),
           '{GEOM_MSG} (' || CAST(n AS VARCHAR) || ' rows)'
    FROM (SELECT count_if(geometry IS NOT NULL AND {PL} IS NULL) AS n FROM {edges}) s WHERE n > 0
    UNION ALL
    SELECT 'warning', 'B14', 'nodes', CAST(NULL AS BIGINT),
           'nodes without a path to 1: ' || CAST(n AS VARCHAR)
    FROM (SELECT count_if(component <> (SELECT component FROM {components} WHERE node = 1)) AS n
          FROM {components}) c WHERE n > 0"""


T_COMP = [
    ("tarcs", 'SELECT "from" AS src, "to" AS dst FROM tedges WHERE "from" <> "to" '
              'UNION ALL SELECT "to", "from" FROM tedges WHERE "from" <> "to"'),
    ("treach(node, lbl)", """SELECT node, node FROM tnodes
        UNION SELECT a.dst, r.lbl FROM treach r JOIN tarcs a ON a.src = r.node"""),
    ("tcomp", "SELECT node, min(lbl) AS component FROM treach GROUP BY node"),
]


@register("b17_validate_network", validate_sql(), ctes=NET_T + T_COMP)
def b17_validate_network(spark, sf_dir):
    return validate_network(X.trade_network(spark, sf_dir, paired=True))


def _validate_range_sql():
    node_f = SV.col_findings("vrange_nodes", SV.node_value_specs())
    edge_f = SV.col_findings("vrange_edges", SV.edge_value_specs())
    return f"""
    SELECT 'warning' AS severity, 'B4' AS rule, 'nodes' AS entity, CAST(NULL AS BIGINT) AS key,
           'housing absent, derived from population' AS message
    UNION ALL {FIND}{node_f} a UNION ALL {FIND}{edge_f} b
    UNION ALL
    SELECT 'warning', 'B16', 'edges', CAST(NULL AS BIGINT),
           '{GEOM_MSG} (' || CAST(n AS VARCHAR) || ' rows)'
    FROM (SELECT count_if(geometry IS NOT NULL AND {PL} IS NULL) AS n FROM vrange_edges) s WHERE n > 0"""


@register("b17_validate_range", _validate_range_sql(), ctes=CTES)
def b17_validate_range(spark, sf_dir):
    return validate_network(VA.range_variant(spark, sf_dir))


@register("b17_findings_summary", f"""
    SELECT CAST(count_if(severity = 'error') AS BIGINT) AS n_errors,
           CAST(count_if(severity = 'warning') AS BIGINT) AS n_warnings,
           count_if(severity = 'error') = 0 AS valid
    FROM (SELECT 'error' AS severity FROM vorphan_nodes WHERE false
          UNION ALL SELECT 'error' FROM (SELECT count(*) AS j, min(node) AS lo, max(node) AS hi
                FROM vorphan_nodes) s WHERE NOT (lo = 1 AND hi = j)
          UNION ALL SELECT 'warning'
          UNION ALL SELECT 'warning' FROM (SELECT count_if(geometry IS NOT NULL AND {PL} IS NULL) AS n
                FROM tedges) g WHERE n > 0) f""", ctes=CTES)
def b17_findings_summary(spark, sf_dir):
    return V.findings_summary(validate_network(VA.orphan_variant(spark, sf_dir)))


@register("b18_network_summary", "SELECT (SELECT count(*) FROM tnodes) AS n_nodes, "
          "(SELECT count(*) FROM tedges) AS n_edges, "
          "(SELECT CAST(max(product) AS INTEGER) FROM tnodes) AS n_goods")
def b18_network_summary(spark, sf_dir):
    net = X.trade_network(spark, sf_dir)
    return V.network_summary(net.nodes.drop("nationkey"), net.edges)


@register("b18_network_summary_nation",
          "SELECT (SELECT count(*) FROM nnodes) AS n_nodes, (SELECT count(*) FROM nedges) AS "
          "n_edges, (SELECT CAST(max(product) AS INTEGER) FROM nnodes) AS n_goods",
          ctes=NET_T + SV.NATION)
def b18_network_summary_nation(spark, sf_dir):
    net = VA.nation_network(spark, sf_dir)
    return V.network_summary(net.nodes, net.edges)


HALF = ("SELECT 'info' AS severity, 'B17' AS rule, '{0}' AS entity, CAST(NULL AS BIGINT) AS key, "
        "'{0} present, {1} absent' AS message")
B4_ABSENT = ("SELECT 'warning' AS severity, 'B4' AS rule, 'nodes' AS entity, "
             "CAST(NULL AS BIGINT) AS key, 'housing absent, derived from population' AS message")


@register("b17_nodes_only", f"{B4_ABSENT} UNION ALL "
          f"{FIND}{SV.col_findings('tnodes', SV.node_value_specs())} a UNION ALL "
          + HALF.format("nodes", "edges"), ctes=CTES)
def b17_nodes_only(spark, sf_dir):
    return validate_network(X.NetworkTables(X.trade_nodes(spark, sf_dir), None))


@register("b17_edges_only", f"{FIND}{SV.col_findings('vrange_edges', SV.edge_value_specs())} a "
          "UNION ALL " + HALF.format("edges", "nodes"), ctes=CTES)
def b17_edges_only(spark, sf_dir):
    return validate_network(X.NetworkTables(None, VA.range_variant(spark, sf_dir).edges.drop("geometry")))


@register("b17_half_is_not_valid", "SELECT CAST(0 AS BIGINT) AS n_errors, CAST(0 AS BIGINT) AS "
          "n_warnings, count(*) < 0 AS valid FROM tedges")
def b17_half_is_not_valid(spark, sf_dir):
    edges = X.trade_edges(spark, sf_dir).drop("geometry")
    return V.findings_summary(validate_network(X.NetworkTables(None, edges)))


@register("b17_validate_raw", f"{B4_ABSENT} UNION ALL {_types_sql()}", ctes=CTES)
def b17_validate_raw(spark, sf_dir):
    """Typing errors in both tables end the checks there."""
    return validate_network(VA.types_variant(spark, sf_dir), raw=True)


@register("b4_housing_gaps", "SELECT node, CAST(NULL AS DOUBLE) AS housing FROM tnodes", ("housing",))
def b4_housing_gaps(spark, sf_dir):
    """One missing value among the nodes: no housing value is used."""
    n = X.trade_nodes(spark, sf_dir)
    n = n.withColumn("housing", F.when(F.col("node") % 50 != 0, F.col("population") * 0.3))
    return V.drop_incomplete_housing(n).select("node", "housing")


@register("b13_bounds_nan", """
    SELECT 'warning' AS severity, 'B13' AS rule, 'edges' AS entity, edge_id AS key,
           'edge ' || CAST(edge_id AS VARCHAR) || ': Iu below Ijk, lifted to Ijk' AS message
    FROM tedges WHERE ("from" + "to") % 4 = 0""")
def b13_bounds_nan(spark, sf_dir):
    """``Il`` NaN or infinite everywhere: no finding about it; ``Iu`` below Ijk on a modulus."""
    s = F.col("from") + F.col("to")
    e = X.trade_edges(spark, sf_dir)
    e = (e.withColumn("Il", F.when(s % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
         .withColumn("Iu", F.when(s % 4 == 0, F.col("Ijk") - 1).when(s % 4 == 1, F.lit(float("nan")))
                     .otherwise(F.lit(float("-inf")))))
    return V.check_bounds(e)


# All cross rules on one network: two rows per edge on a modulus, loops, unknown ends and bounds.
MIXED = [("vmixed", """
    SELECT edge_id, "from", CASE WHEN ("from" + "to") % 23 = 0 THEN "from"
                                 WHEN ("from" + "to") % 31 = 0 THEN -1 ELSE "to" END AS "to", Ijk,
           CASE WHEN ("from" + "to") % 3 = 0 THEN Ijk + 1 END AS Il,
           CASE WHEN ("from" + "to") % 4 = 0 THEN Ijk - 1 END AS Iu FROM tedges
    UNION ALL SELECT edge_id + 1000000000000, "to", "from", Ijk, CAST(NULL AS DOUBLE),
           CAST(NULL AS DOUBLE) FROM tedges WHERE ("from" + "to") % 7 = 0""")]


@register("b10_b13_mixed", """
    SELECT * FROM (WITH g AS (SELECT *, "to" > 0 AS good,
              min(edge_id) OVER (PARTITION BY least("from", "to"), greatest("from", "to")) AS first_id FROM vmixed)
    SELECT 'error' AS severity, 'B10' AS rule, 'edges' AS entity, edge_id AS key,
           'edge ' || CAST(edge_id AS VARCHAR) || ': unknown endpoint, ' || CAST("from" AS VARCHAR) || ' > ' ||
           CAST("to" AS VARCHAR) AS message FROM g WHERE NOT good
    UNION ALL SELECT 'error', 'B11', 'edges', edge_id, 'edge ' || CAST(edge_id AS VARCHAR) || ': both ends at ' ||
           CAST("from" AS VARCHAR) FROM g WHERE good AND "from" = "to"
    UNION ALL SELECT 'error', 'B12', 'edges', edge_id, 'edge ' || CAST(edge_id AS VARCHAR) || ' repeats edge ' ||
           CAST(first_id AS VARCHAR) || ' between ' || CAST("from" AS VARCHAR) || ' and ' || CAST("to" AS VARCHAR)
           FROM g WHERE good AND edge_id <> first_id
    UNION ALL SELECT 'warning', 'B13', 'edges', edge_id, 'edge ' || CAST(edge_id AS VARCHAR) ||
           ': Il above Ijk, cut to Ijk' FROM g WHERE good AND Il > Ijk
    UNION ALL SELECT 'warning', 'B13', 'edges', edge_id, 'edge ' || CAST(edge_id AS VARCHAR) ||
           ': Iu below Ijk, lifted to Ijk' FROM g WHERE good AND Iu < Ijk) m""", ctes=NET_T + MIXED)
def b10_b13_mixed(spark, sf_dir):
    s = F.col("from") + F.col("to")
    e = X.trade_edges(spark, sf_dir).select("edge_id", "from", "to", "Ijk")
    none = F.lit(None).cast("double")
    first = e.select("edge_id", "from", F.when(s % 23 == 0, F.col("from")).when(s % 31 == 0, F.lit(-1))
                     .otherwise(F.col("to")).cast("long").alias("to"), "Ijk",
                     F.when(s % 3 == 0, F.col("Ijk") + 1).alias("Il"), F.when(s % 4 == 0, F.col("Ijk") - 1).alias("Iu"))
    again = e.filter(s % 7 == 0).select(
        (F.col("edge_id") + 1000000000000).alias("edge_id"), F.col("to").alias("from"), F.col("from").alias("to"),
        "Ijk", none.alias("Il"), none.alias("Iu"))
    return V.check_edges(first.unionByName(again), X.trade_nodes(spark, sf_dir))
