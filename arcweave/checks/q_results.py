"""Registered queries: result tables on the trade network (F1, F2 and their parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcweave.checks import sqlparts as S
from arcweave.checks.registry import register
from arcweave.operators import aggregates as A
from arcweave.operators.arcs import symmetrise, to_arcs, to_pairs
from arcweave.plans.results import edge_table, node_table, run_diff
from arcweave.sources import fixtures as X

N_GOODS = X.N_GOODS_FROM_PARTS
F1_DOUBLES = ("delta_i", "delta_tau", "Ijk_orig", "Ijk", "increase", "perc_upgraded",
              *[f"Qjk_{g}" for g in range(1, N_GOODS + 1)], "Qjk_total")

_f1_ctes, _f1_final = S.edge_table("result")


@register("f1_edge_table", _f1_final, F1_DOUBLES, ctes=S.NET_T + _f1_ctes)
def f1_edge_table(spark, sf_dir):
    net = X.trade_network(spark, sf_dir, paired=True)
    alloc = X.trade_allocations(spark, sf_dir, net, paired=True)
    return edge_table(net, alloc.arc_infra, alloc.arc_flow, "result", N_GOODS)


_f1b_ctes, _f1b_final = S.edge_table("baseline", prefix="f1b")


@register("f1_edge_table_baseline", _f1b_final, F1_DOUBLES, ctes=S.NET_T + _f1b_ctes)
def f1_edge_table_baseline(spark, sf_dir):
    net = X.trade_network(spark, sf_dir, paired=True)
    alloc = X.trade_allocations(spark, sf_dir, net, paired=True)
    return edge_table(net, alloc.arc_infra, alloc.arc_flow, "baseline", N_GOODS)


_nf = [("nfedges", """SELECT * REPLACE (CASE WHEN ("from" + "to") % 5 < 2 THEN NULL ELSE Iu END AS Iu)
    FROM tedges""")]
_f1n_ctes, _f1n_final = S.edge_table("result", edges="nfedges", prefix="f1n")


@register("f1_edge_table_nonfinite", _f1n_final, F1_DOUBLES, ctes=S.NET_T + _nf + _f1n_ctes)
def f1_edge_table_nonfinite(spark, sf_dir):
    """``Iu`` NaN or infinite on a modulus counts as unbounded."""
    net = X.trade_network(spark, sf_dir)
    alloc = X.trade_allocations(spark, sf_dir, net)
    m = (F.col("from") + F.col("to")) % 5
    edges = net.edges.withColumn("Iu", F.when(m == 0, F.lit(float("nan"))).when(
        m == 1, F.lit(float("inf"))).otherwise(F.col("Iu")))
    return edge_table(X.NetworkTables(net.nodes, edges), alloc.arc_infra, alloc.arc_flow, "result", N_GOODS)


@register("f1_edge_inputs", 'SELECT "from", "to", delta_i, delta_tau, Ijk AS Ijk_orig FROM tedges',
          ("delta_i", "delta_tau", "Ijk_orig"))
def f1_edge_inputs(spark, sf_dir):
    return edge_table(X.trade_network(spark, sf_dir))


F2_DOUBLES = ("lon", "lat", "population", "productivity",
              "uj_orig", "c_pc_orig", "c_agg_orig", "PCj_orig", "Lj_orig", "Yj_orig",
              "uj", "c_pc", "c_agg", "PCj", "Lj", "Yj",
              "uj_gain_pct", "c_pc_gain_pct", "c_agg_gain_pct", "PCj_gain_pct")


def _f2_sql() -> str:
    def run_cols(run, sfx):
        return f"""(SELECT a.node, a.uj AS uj{sfx}, a.c_pc AS c_pc{sfx}, a.c_agg AS c_agg{sfx},
                   a.PCj AS PCj{sfx}, a.Lj AS Lj{sfx}, y.Yj AS Yj{sfx}
            FROM talloc a LEFT JOIN (SELECT node, sum(y) AS Yj FROM toutput
                                     WHERE run_id = '{run}' GROUP BY node) y ON y.node = a.node
            WHERE a.run_id = '{run}')"""
    gains = ", ".join(f"{S.pct_gain('r.' + c, 'b.' + c + '_orig')} AS {c}_gain_pct"
                      for c in ("uj", "c_pc", "c_agg", "PCj"))
    return f"""
    SELECT n.node, n.lon, n.lat, n.population, n.productivity, n.product, n.name,
           b.uj_orig, b.c_pc_orig, b.c_agg_orig, b.PCj_orig, b.Lj_orig, b.Yj_orig,
           r.uj, r.c_pc, r.c_agg, r.PCj, r.Lj, r.Yj, {gains}
    FROM tnodes n
    LEFT JOIN {run_cols('baseline', '_orig')} b ON b.node = n.node
    LEFT JOIN {run_cols('result', '')} r ON r.node = n.node"""


@register("f2_node_table", _f2_sql(), F2_DOUBLES)
def f2_node_table(spark, sf_dir):
    net = X.trade_network(spark, sf_dir)
    alloc = X.trade_allocations(spark, sf_dir, net)
    nodes = X.NetworkTables(net.nodes.drop("nationkey"), net.edges)
    return node_table(nodes, alloc.node_alloc, alloc.node_output)


@register("g1_to_arcs", 'SELECT "from" AS src, "to" AS dst, edge_id, Ijk FROM tedges '
                        'UNION ALL SELECT "to", "from", edge_id, Ijk FROM tedges', ("Ijk",))
def g1_to_arcs(spark, sf_dir):
    return to_arcs(X.trade_edges(spark, sf_dir).select("edge_id", "from", "to", "Ijk"))


@register("g2_to_pairs", "SELECT DISTINCT run_id, least(src, dst) AS pair_lo, "
                         "greatest(src, dst) AS pair_hi FROM tflow")
def g2_to_pairs(spark, sf_dir):
    return to_pairs(X.trade_arc_flow(spark, sf_dir), keys=("run_id",))


@register("d4_symmetrise", f"SELECT run_id, least(src, dst) AS pair_lo, greatest(src, dst) AS "
                           f"pair_hi, sum(ijk * {S.W}) AS ijk FROM tinfra "
                           f"GROUP BY run_id, least(src, dst), greatest(src, dst)", ("ijk",))
def d4_symmetrise(spark, sf_dir):
    infra = X.trade_allocations(spark, sf_dir, paired=True).arc_infra
    return symmetrise(infra, ["ijk"], keys=("run_id",))


@register("e5_global_cap", "SELECT coalesce(max(CASE WHEN isfinite(Iu) THEN Iu END), "
                          "greatest(max(Ijk * 2), max(Ijk))) AS cap FROM tedges", ("cap",))
def e5_global_cap(spark, sf_dir):
    edges = X.trade_edges(spark, sf_dir).select("Iu", F.col("Ijk").alias("Ijk_orig"),
                                                (F.col("Ijk") * 2).alias("Ijk"))
    return A.global_cap(edges)


@register("e5_global_cap_unbounded",
          "SELECT greatest(max(Ijk * 2), max(Ijk)) AS cap FROM tedges", ("cap",))
def e5_global_cap_unbounded(spark, sf_dir):
    edges = X.trade_edges(spark, sf_dir).select(
        F.lit(None).cast("double").alias("Iu"), F.col("Ijk").alias("Ijk_orig"),
        (F.col("Ijk") * 2).alias("Ijk"))
    return A.global_cap(edges)


@register("e6_edge_flows_long", f"SELECT run_id, least(src, dst) AS pair_lo, greatest(src, dst) "
                                f"AS pair_hi, good, sum(q * {S.W}) AS q FROM tflow "
                                f"GROUP BY run_id, least(src, dst), greatest(src, dst), good",
          ("q",))
def e6_edge_flows_long(spark, sf_dir):
    return A.edge_flows_long(X.trade_allocations(spark, sf_dir, paired=True).arc_flow, keys=("run_id",))


def _wide_sql():
    goods = ", ".join(f"sum(CASE WHEN good = {g} THEN q * {S.W} ELSE 0 END) AS Qjk_{g}"
                      for g in range(1, N_GOODS + 1))
    return (f"SELECT run_id, least(src, dst) AS pair_lo, greatest(src, dst) AS pair_hi, {goods}, "
            f"sum(q * {S.W}) AS Qjk_total FROM tflow "
            f"GROUP BY run_id, least(src, dst), greatest(src, dst)")


@register("e7_edge_flows_wide", _wide_sql(),
          (*[f"Qjk_{g}" for g in range(1, N_GOODS + 1)], "Qjk_total"))
def e7_edge_flows_wide(spark, sf_dir):
    return A.edge_flows_wide(X.trade_allocations(spark, sf_dir, paired=True).arc_flow, N_GOODS, keys=("run_id",))


@register("e8_edge_flow_total", f"SELECT run_id, least(src, dst) AS pair_lo, greatest(src, dst) "
                                f"AS pair_hi, sum(q * {S.W}) AS Qjk_total FROM tflow "
                                f"GROUP BY run_id, least(src, dst), greatest(src, dst)",
          ("Qjk_total",))
def e8_edge_flow_total(spark, sf_dir):
    long = A.edge_flows_long(X.trade_allocations(spark, sf_dir, paired=True).arc_flow, keys=("run_id",))
    return A.edge_flow_total(long, keys=("run_id",))


@register("e9_node_production", "SELECT run_id, node, sum(y) AS Yj FROM toutput "
                                "GROUP BY run_id, node", ("Yj",))
def e9_node_production(spark, sf_dir):
    return A.node_production(X.trade_node_output(X.trade_arc_flow(spark, sf_dir)))


@register("e10_ces_aggregate", "SELECT run_id, node, c_agg FROM tces", ("c_agg",))
def e10_ces_aggregate(spark, sf_dir):
    flow = X.trade_arc_flow(spark, sf_dir)
    per_good = flow.groupBy("run_id", F.col("dst").alias("node"), "good").agg(
        F.sum("q").alias("c"))
    return A.ces_aggregate(per_good, ["run_id", "node"], "c", X.TRADE_PARAMS["sigma"])


@register("e11_congestion_aggregate",
          "SELECT run_id, src, dst, pow(sum(pow(q, 2.0)), 0.5) AS q_congestion FROM tflow "
          "GROUP BY run_id, src, dst", ("q_congestion",))
def e11_congestion_aggregate(spark, sf_dir):
    return A.congestion_aggregate(X.trade_arc_flow(spark, sf_dir), None, X.TRADE_PARAMS["nu"],
                                  keys=("run_id", "src", "dst"))


@register("e12_welfare", "SELECT run_id, sum(uj * Lj) AS welfare FROM talloc GROUP BY run_id",
          ("welfare",))
def e12_welfare(spark, sf_dir):
    return A.welfare(X.trade_allocations(spark, sf_dir).node_alloc)


@register("e12_welfare_gain", f"""
    SELECT w AS welfare, wb AS welfare_baseline, {S.pct_gain('w', 'wb')} AS welfare_gain_pct
    FROM (SELECT max(CASE WHEN run_id = 'result' THEN s END) AS w,
                 max(CASE WHEN run_id = 'baseline' THEN s END) AS wb
          FROM (SELECT run_id, sum(uj * Lj) AS s FROM talloc GROUP BY run_id) x) y""",
    ("welfare", "welfare_baseline", "welfare_gain_pct"))
def e12_welfare_gain(spark, sf_dir):
    return A.welfare_gain(A.welfare(X.trade_allocations(spark, sf_dir).node_alloc))


def _d9_sql():
    metrics = ["uj", "c_pc", "PCj"]
    rows = " UNION ALL ".join(
        f"SELECT coalesce(a.node, b.node) AS node, '{m}' AS metric, a.{m} AS a, b.{m} AS b "
        f"FROM (SELECT * FROM talloc WHERE run_id = 'baseline') a FULL OUTER JOIN "
        f"(SELECT * FROM talloc WHERE run_id = 'result') b ON a.node = b.node" for m in metrics)
    return (f"SELECT node, metric, a, b, b - a AS diff, {S.pct_gain('b', 'a')} AS pct "
            f"FROM ({rows}) u")


@register("d9_run_diff", _d9_sql(), ("a", "b", "diff", "pct"))
def d9_run_diff(spark, sf_dir):
    alloc = X.trade_allocations(spark, sf_dir).node_alloc
    a = alloc.filter(F.col("run_id") == "baseline")
    b = alloc.filter(F.col("run_id") == "result")
    return run_diff(a, b, ["node"], ["uj", "c_pc", "PCj"])
