"""Registered queries: model tables, budgets, formulas, catalogues, scaling, ETL, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcweave.checks import sql_variants as SV
from arcweave.checks import sqlparts as S
from arcweave.checks.q_validate import T_COMP, validate_sql
from arcweave.checks.registry import register
from arcweave.functions import (production, round_sig, transform_value, transport_cost,
                                utility)
from arcweave.operators import aggregates as A
from arcweave.operators import validate as V
from arcweave.operators.arcs import PAIR, effective_bounds, effective_housing, productivity_long
from arcweave.operators.joins import join_by_pair
from arcweave.plans import model as M
from arcweave.plans.etl import build_network_from_raw, build_validated_network, derive_edge_attributes
from arcweave.plans.publish import scaled_features
from arcweave.plans.results import edge_table, node_table
from arcweave.session import scratch_dir
from arcweave.sources import fixtures as X
from arcweave.sources import variants as VA

NG = X.N_GOODS_FROM_PARTS
F1C, F1F = S.edge_table("result")
CTES = S.NET_T + SV.VARIANTS


def _f1(spark, sf_dir, net=None):
    net = X.trade_network(spark, sf_dir, paired=True) if net is None else net
    alloc = X.trade_allocations(spark, sf_dir, net, paired=True)
    return edge_table(net, alloc.arc_infra, alloc.arc_flow, "result", NG)


# ---------------------------------------------------------------- F3 and its parts

@register("f3_model_arcs", """
    SELECT "from" AS src, "to" AS dst, delta_i, delta_tau, Ijk AS I0,
           CASE WHEN Il IS NOT NULL THEN least(Il, Ijk) ELSE Ijk END AS Il,
           CASE WHEN Iu IS NOT NULL THEN greatest(Iu, Ijk) END AS Iu FROM tedges
    UNION ALL
    SELECT "to", "from", delta_i, delta_tau, Ijk,
           CASE WHEN Il IS NOT NULL THEN least(Il, Ijk) ELSE Ijk END,
           CASE WHEN Iu IS NOT NULL THEN greatest(Iu, Ijk) END FROM tedges""",
          ("delta_i", "delta_tau", "I0", "Il", "Iu"))
def f3_model_arcs(spark, sf_dir):
    return M.model_tables(X.trade_network(spark, sf_dir)).arcs


@register("c7_effective_bounds_downgrade", """
    SELECT edge_id, CASE WHEN Il IS NOT NULL THEN least(Il, Ijk) ELSE CAST(0 AS DOUBLE) END
             AS Il_eff,
           CASE WHEN Iu IS NOT NULL THEN greatest(Iu, Ijk) END AS Iu_eff FROM vbounds_edges""",
          ("Il_eff", "Iu_eff"), ctes=CTES)
def c7_effective_bounds_downgrade(spark, sf_dir):
    e = VA.bounds_variant(spark, sf_dir).edges
    return effective_bounds(e, allow_downgrade=True).select("edge_id", "Il_eff", "Iu_eff")


@register("d7_productivity_own", "SELECT node, product AS good, productivity AS z FROM tnodes",
          ("z",))
def d7_productivity_own(spark, sf_dir):
    return productivity_long(X.trade_nodes(spark, sf_dir))


@register("d7_productivity_floor", """
    SELECT n.node, CAST(g.good AS INTEGER) AS good,
           greatest(CASE WHEN g.good = n.product THEN n.productivity ELSE 0.0 END, 0.001) AS z
    FROM tnodes n CROSS JOIN (SELECT unnest(range(1, (SELECT max(product) FROM tnodes) + 1))
                              AS good) g""", ("z",))
def d7_productivity_floor(spark, sf_dir):
    return productivity_long(X.trade_nodes(spark, sf_dir), floor=1e-3)


@register("c8_effective_housing", "SELECT node, population * (1 - 0.5) AS Hj FROM tnodes",
          ("Hj",))
def c8_effective_housing(spark, sf_dir):
    return effective_housing(X.trade_nodes(spark, sf_dir), 0.5).select("node", "Hj")


@register("c8_housing_with_missing", """
    SELECT node, CASE WHEN (SELECT count_if(node % 50 = 0) FROM tnodes) = 0
                      THEN population * 0.3 ELSE population * (1 - 0.7) END AS Hj FROM tnodes""",
          ("Hj",))
def c8_housing_with_missing(spark, sf_dir):
    n = X.trade_nodes(spark, sf_dir)
    n = n.withColumn("housing", F.when(F.col("node") % 50 != 0, F.col("population") * 0.3))
    return effective_housing(n, 0.7).select("node", "Hj")


# ---------------------------------------------------------------- budgets

def _e1_sql(src: str) -> str:
    kmax = ("CASE WHEN count_if(Iu IS NULL OR NOT isfinite(Iu)) = 0 "
            "THEN sum(delta_i * greatest(Iu, Ijk)) END")
    raw = ("CASE WHEN K_max IS NULL THEN K_base * 1.2 "
           "ELSE least(K_base * 1.2, K_base + 0.5 * (K_max - K_base)) END")
    return (f"SELECT K_base, K_max, {S.round_sig(raw, 4)} AS K_suggested FROM "
            f"(SELECT sum(delta_i * Ijk) AS K_base, {kmax} AS K_max FROM {src}) s")


@register("e1_budget_stats", _e1_sql("tedges"), ("K_base", "K_max", "K_suggested"))
def e1_budget_stats(spark, sf_dir):
    return A.budget_stats(X.trade_edges(spark, sf_dir))


@register("e1_budget_stats_bounded",
          _e1_sql("(SELECT * REPLACE (CAST(100 AS DOUBLE) AS Iu) FROM tedges) b"),
          ("K_base", "K_max", "K_suggested"))
def e1_budget_stats_bounded(spark, sf_dir):
    return A.budget_stats(VA.bounded_variant(spark, sf_dir).edges)


def _result_arcs(spark, sf_dir):
    net = X.trade_network(spark, sf_dir)
    arcs = M.model_tables(net).arcs
    infra = X.trade_allocations(spark, sf_dir).arc_infra.filter(F.col("run_id") == "result").drop("run_id")
    return arcs.join(infra, ["src", "dst"])


RESULT_ARCS = """(SELECT a.*, i.ijk AS inew FROM (
    SELECT "from" AS src, "to" AS dst, delta_i, Ijk AS I0, Il, Iu FROM tedges
    UNION ALL SELECT "to", "from", delta_i, Ijk, Il, Iu FROM tedges) a
    JOIN (SELECT src, dst, ijk FROM tinfra WHERE run_id = 'result') i
      ON i.src = a.src AND i.dst = a.dst)"""


@register("e4_budget_spent", f"SELECT sum(delta_i * inew) AS spent FROM {RESULT_ARCS} r",
          ("spent",))
def e4_budget_spent(spark, sf_dir):
    return A.budget_spent(_result_arcs(spark, sf_dir))


_E3 = [("e3arcs", f"SELECT src, dst, delta_i, inew FROM {RESULT_ARCS} r"),
       ("e3spent", "SELECT sum(delta_i * inew) AS spent FROM e3arcs"),
       ("e3k", "SELECT sum(delta_i * Ijk) * 2 * 1.2 AS K FROM tedges")]


@register("e3_rescale_to_budget", """
    SELECT a.src, a.dst, a.inew * (k.K / s.spent) AS ijk FROM e3arcs a CROSS JOIN e3k k CROSS JOIN e3spent s""",
          ("ijk",), ctes=S.NET_T + _E3)
def e3_rescale_to_budget(spark, sf_dir):
    arcs = _result_arcs(spark, sf_dir).select("src", "dst", "delta_i", "ijk")
    K = X.trade_edges(spark, sf_dir).agg((F.sum(F.col("delta_i") * F.col("Ijk")) * 2 * 1.2)
                                         .alias("K"))
    return A.rescale_to_budget(arcs, K).select("src", "dst", "ijk")


@register("e3_rescale_identity", "SELECT src, dst, inew AS ijk, true AS same FROM e3arcs", ("ijk",),
          ctes=S.NET_T + _E3)
def e3_rescale_identity(spark, sf_dir):
    """With K the exact cost, infrastructure keeps every bit, although the two totals come from other partitions."""
    arcs = _result_arcs(spark, sf_dir).select("src", "dst", "delta_i", "ijk")
    K = A.budget_spent(arcs.repartition(13)).select(F.col("spent").alias("K"))
    after = A.rescale_to_budget(arcs.withColumn("before", F.col("ijk")), K)
    return after.select("src", "dst", "ijk", (F.col("ijk") == F.col("before")).alias("same"))


@register("b19_check_solution", f"""
    SELECT spent, K * 2 AS budget, abs(spent - K * 2) <= 0.001 * (K * 2) AS budget_ok,
           CAST(n_below AS BIGINT) AS n_below, CAST(n_above AS BIGINT) AS n_above,
           CAST(0 AS BIGINT) AS n_percent
    FROM (SELECT sum(delta_i * inew) AS spent,
                 count_if(inew < (CASE WHEN Il IS NOT NULL THEN least(Il, I0) ELSE I0 END)
                          - 1e-6) AS n_below,
                 count_if(Iu IS NOT NULL AND inew > greatest(Iu, I0) + 1e-6) AS n_above
          FROM {RESULT_ARCS} r) s
    CROSS JOIN (SELECT sum(delta_i * Ijk) * 1.1 AS K FROM tedges) k""", ("spent", "budget"))
def b19_check_solution(spark, sf_dir):
    arcs = _result_arcs(spark, sf_dir)
    K = X.trade_edges(spark, sf_dir).agg((F.sum(F.col("delta_i") * F.col("Ijk")) * 1.1)
                                         .alias("K"))
    return V.check_solution(arcs, K)


# ---------------------------------------------------------------- formulas

@register("c21_utility", f"""
    SELECT run_id, node, {S.utility('c_pc', '0.5', '0.5', '0.0')} AS u_rho0,
           {S.utility('c_pc', '0.5', '0.5', '1.0')} AS u_rho1,
           {S.utility('c_pc', '0.5', '0.5', '2.0')} AS u_rho2 FROM talloc""",
          ("u_rho0", "u_rho1", "u_rho2"))
def c21_utility(spark, sf_dir):
    a = X.trade_allocations(spark, sf_dir).node_alloc
    return a.select("run_id", "node", *[utility("c_pc", 0.5, 0.5, float(r)).alias(f"u_rho{r}")
                                        for r in (0, 1, 2)])


@register("c22_transport_cost", f"""
    SELECT f.run_id, f.src, f.dst,
           {S.finite("CASE WHEN pow(i.ijk, 1.0) <> 0 THEN a.delta_tau * pow(f.q, 1.0) / pow(i.ijk, 1.0) END")}
             AS tau
    FROM (SELECT run_id, src, dst, sum(q) AS q FROM tflow GROUP BY run_id, src, dst) f
    JOIN tinfra i ON i.run_id = f.run_id AND i.src = f.src AND i.dst = f.dst
    JOIN (SELECT "from" AS src, "to" AS dst, delta_tau FROM tedges
          UNION ALL SELECT "to", "from", delta_tau FROM tedges) a
      ON a.src = f.src AND a.dst = f.dst""", ("tau",))
def c22_transport_cost(spark, sf_dir):
    net = X.trade_network(spark, sf_dir, paired=True)
    alloc = X.trade_allocations(spark, sf_dir, net, paired=True)
    q = alloc.arc_flow.groupBy("run_id", "src", "dst", *PAIR).agg(F.sum("q").alias("q"))
    arcs = M.model_tables(net).arcs.select("src", "dst", "delta_tau", *PAIR)
    j = join_by_pair(join_by_pair(q, alloc.arc_infra, ["run_id", "src", "dst"]), arcs, ["src", "dst"])
    p = X.TRADE_PARAMS
    return j.select("run_id", "src", "dst",
                    transport_cost("delta_tau", "q", "ijk", p["beta"], p["gamma"]).alias("tau"))


@register("c23_production", f"""
    SELECT node, product AS good, {S.finite('productivity * pow(population, 0.8)')} AS y
    FROM tnodes""", ("y",))
def c23_production(spark, sf_dir):
    n = X.trade_nodes(spark, sf_dir)
    z = productivity_long(n).join(n.select("node", "population"), "node")
    return z.select("node", "good", production("z", "population", 0.8).alias("y"))


@register("c9_round_sig", f"""
    SELECT run_id, node, {S.round_sig('c_agg', 4)} AS c_agg_4, {S.round_sig('c_agg', 7)} AS c_agg_7,
           {S.round_sig('uj', 7)} AS uj_7 FROM talloc""", ("c_agg_4", "c_agg_7", "uj_7"))
def c9_round_sig(spark, sf_dir):
    a = X.trade_allocations(spark, sf_dir).node_alloc
    return a.select("run_id", "node", round_sig("c_agg", 4).alias("c_agg_4"),
                    round_sig("c_agg", 7).alias("c_agg_7"), round_sig("uj", 7).alias("uj_7"))


TF = {"level": "x", "log": "CASE WHEN x > 0 THEN ln(x) END",
      "log10": "CASE WHEN x > 0 THEN log10(x) END", "log1p": "CASE WHEN x > -1 THEN ln(1 + x) END",
      "sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END", "cbrt": "cbrt(x)"}


@register("c14_transform_value", f"""
    SELECT "from", "to", {", ".join(f"{v.replace('x', 'd')} AS t_{k}" for k, v in TF.items())}
    FROM (SELECT "from", "to", increase - 5 AS d FROM ({F1F}) f) q""",
          tuple(f"t_{k}" for k in TF), ctes=S.NET_T + F1C)
def c14_transform_value(spark, sf_dir):
    t = _f1(spark, sf_dir).select("from", "to", (F.col("increase") - 5).alias("d"))
    return t.select("from", "to", *[transform_value("d", k).alias(f"t_{k}") for k in TF])


# ---------------------------------------------------------------- catalogues and scaling

def _catalogue_sql(src: str, metrics: list[tuple]) -> str:
    parts = []
    for pos, (key, label, pal, div, dom) in enumerate(metrics):
        v = f'CASE WHEN isfinite("{key}") THEN "{key}" END'
        lo, hi = f"min({v})", f"max({v})"
        if dom is not None:
            lo_v = f"CASE WHEN {hi} IS NOT NULL THEN CAST({dom[0]} AS DOUBLE) END"
            hi_v = f"CASE WHEN {hi} IS NOT NULL THEN CAST({dom[1]} AS DOUBLE) END"
        elif div:
            m = f"greatest(abs({lo}), abs({hi}))"
            lo_v, hi_v = f"-{m}", m
        else:
            lo_v, hi_v = lo, hi
        lab = label.replace("'", "''")
        parts.append(f"SELECT {pos} AS position, '{key}' AS key, '{lab}' AS label, '{pal}' AS "
                     f"palette, {S.round_sig(lo_v, 7)} AS min, {S.round_sig(hi_v, 7)} AS max, "
                     f"{'true' if div else 'false'} AS diverging FROM {src} "
                     f"HAVING {hi} IS NOT NULL")
    return " UNION ALL ".join(parts)


def _edge_metrics():
    # Fixed values, stated here again so that the SQL does not take them from the engine
    return [
        ("Ijk", "Final infrastructure (Ijk)", "viridis", False, None),
        ("increase", "Infrastructure increase (Ijk − initial)", "ylorrd", False, None),
        ("perc_upgraded", "Percent upgraded (% of Iu − initial)", "ylorrd", False, (0.0, 100.0)),
        ("Qjk_total", "Total flow (all goods)", "ylorrd", False, None),
        *[(f"Qjk_{g}", f"Flow of good {g}", "ylorrd", False, None) for g in range(1, NG + 1)],
        ("Ijk_orig", "Initial infrastructure (input Ijk)", "inferno", False, None),
    ]


@register("e14_edge_metric_catalogue", _catalogue_sql("f1", _edge_metrics()), ("min", "max"),
          ctes=S.NET_T + F1C + [("f1", F1F)])
def e14_edge_metric_catalogue(spark, sf_dir):
    return A.edge_metric_catalogue(_f1(spark, sf_dir))


def _node_metrics():
    # Fixed values, as above
    return [
        ("uj_gain_pct", "Welfare (utility) gain %", "rdbu", True, None),
        ("c_pc_gain_pct", "Consumption (per capita) gain %", "rdbu", True, None),
        ("PCj_gain_pct", "Price index change %", "rdbu", True, None),
        ("uj", "Utility per worker (uj)", "viridis", False, None),
        ("c_pc", "Consumption per capita (cj)", "viridis", False, None),
        ("c_agg", "Aggregate consumption (Cj)", "viridis", False, None),
        ("PCj", "Consumption price index (PCj)", "viridis", False, None),
        ("Lj", "Labor / population (Lj)", "viridis", False, None),
        ("Yj", "Production (Yj)", "viridis", False, None),
        ("population", "Population (input)", "viridis", False, None),
        ("productivity", "Productivity (input)", "viridis", False, None),
    ]


F2_FINAL = None


def _f2_cte():
    from arcweave.checks.q_results import _f2_sql
    return ("f2", _f2_sql())


@register("e15_node_metric_catalogue", _catalogue_sql("f2", _node_metrics()), ("min", "max"),
          ctes=S.NET_T + [_f2_cte()])
def e15_node_metric_catalogue(spark, sf_dir):
    net = X.trade_network(spark, sf_dir)
    alloc = X.trade_allocations(spark, sf_dir, net)
    nodes = X.NetworkTables(net.nodes.drop("nationkey"), net.edges)
    return A.node_metric_catalogue(node_table(nodes, alloc.node_alloc, alloc.node_output))


SCALE = {"Ijk": "level", "increase": "log1p", "perc_upgraded": "level", "Qjk_total": "sqrt",
         "delta_tau": "log"}


def _f4_sql():
    doms, scaled = [], []
    for key, tf in SCALE.items():
        tx = TF[tf].replace("x", f'"{key}"')
        t = f"CASE WHEN isfinite({tx}) THEN {tx} END"
        if tf == "level" and key == "perc_upgraded":
            lo, hi = "CAST(0 AS DOUBLE)", "CAST(100 AS DOUBLE)"
        else:
            lo, hi = f"coalesce(min({t}), 0.0)", f"coalesce(max({t}), 1.0)"
        doms.append(f"{lo} AS lo_{key}, CASE WHEN {hi} > {lo} THEN {hi} ELSE {lo} + 1e-9 END "
                    f"AS hi_{key}")
        scaled.append(f"CASE WHEN ({t}) IS NOT NULL THEN least(greatest(({t} - d.lo_{key}) / "
                      f"(d.hi_{key} - d.lo_{key}), 0.0), 1.0) END AS {key}_scaled")
    return (f'SELECT "from", "to", {", ".join(scaled)} FROM f1 CROSS JOIN '
            f"(SELECT {', '.join(doms)} FROM f1) d")


@register("f4_scaled_features", _f4_sql(), tuple(f"{k}_scaled" for k in SCALE),
          ctes=S.NET_T + F1C + [("f1", F1F)])
def f4_scaled_features(spark, sf_dir):
    return scaled_features(_f1(spark, sf_dir), SCALE, ["from", "to"])


#: Domains of E16: those of F4, one metric around zero, and one whose domain is a single value and is widened.
DOMAINS = SCALE | {"Ijk_orig": "level", "one": "level"}


def _e16_sql():
    out = []
    for key, tf in DOMAINS.items():
        tx = TF[tf].replace("x", f'"{key}"') if tf != "level" else f'"{key}"'
        t = f"CASE WHEN isfinite({tx}) THEN {tx} END"
        if key == "perc_upgraded":
            lo, hi = "CAST(0 AS DOUBLE)", "CAST(100 AS DOUBLE)"
        elif key == "Ijk_orig":
            hi = f"greatest(abs(min({t})), abs(max({t})))"
            lo = f"-{hi}"
        else:
            lo, hi = f"coalesce(min({t}), 0.0)", f"coalesce(max({t}), 1.0)"
        out.append(f"{lo} AS lo_{key}, CASE WHEN {hi} > {lo} THEN {hi} ELSE {lo} + 1e-9 END AS hi_{key}")
    return f"SELECT {', '.join(out)} FROM (SELECT *, CAST(1 AS DOUBLE) AS one FROM f1) f"


@register("e16_scale_domains", _e16_sql(), tuple(f"{end}_{k}" for k in DOMAINS for end in ("lo", "hi")),
          ctes=S.NET_T + F1C + [("f1", F1F)])
def e16_scale_domains(spark, sf_dir):
    return A.scale_domains(_f1(spark, sf_dir).withColumn("one", F.lit(1.0)), DOMAINS, diverging=("Ijk_orig",))


@register("e13_run_summary", f"""
    SELECT {S.round_sig('w', 7)} AS welfare, {S.round_sig('wb', 7)} AS welfare_baseline,
           {S.round_sig(S.pct_gain(S.round_sig('w', 7), S.round_sig('wb', 7)), 7)} AS welfare_gain_pct,
           {S.round_sig('e', 7)} AS elapsed, {S.round_sig('k', 7)} AS K
    FROM (SELECT max(CASE WHEN run_id = 'result' THEN s END) AS w,
                 max(CASE WHEN run_id = 'baseline' THEN s END) AS wb
          FROM (SELECT run_id, sum(uj * Lj) AS s FROM talloc GROUP BY run_id) x) y
    CROSS JOIN (SELECT max(value) AS e FROM events WHERE event_type = 'purchase') ev
    CROSS JOIN (SELECT sum(delta_i * Ijk) * 1.2 AS k FROM tedges) kk""",
          ("welfare", "welfare_baseline", "welfare_gain_pct", "elapsed", "K"))
def e13_run_summary(spark, sf_dir):
    w = A.welfare_gain(A.welfare(X.trade_allocations(spark, sf_dir).node_alloc))
    ev = X.read_table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").agg(
        F.max("value").alias("elapsed"))
    k = X.trade_edges(spark, sf_dir).agg((F.sum(F.col("delta_i") * F.col("Ijk")) * 1.2).alias("K"))
    return A.run_summary(w, ev.crossJoin(k))


# ---------------------------------------------------------------- ETL

def _r7(x):
    return S.round_sig(x, 7)


ETL_NODES = f"""
    SELECT CAST(row_number() OVER (ORDER BY row_order) AS BIGINT) AS node, lon, lat,
           {_r7('pop1')} AS population, {_r7('greatest(prod1, 0.001)')} AS productivity,
           CAST(product AS INTEGER) AS product, city_country AS name
    FROM (SELECT *, CASE WHEN outk > 0 THEN prod0 + 2.1 * outk / pop1 ELSE prod0 END AS prod1
          FROM (SELECT *, CASE WHEN popk = 0 THEN 0.001 ELSE popk END AS pop1,
                       CASE WHEN popk > 0 THEN gdp / popk / 1e6 ELSE 0.0 END AS prod0
                FROM (SELECT *, population / 1000 AS popk, outflows / 1000 AS outk
                      FROM raw_nodes) a) b) c"""


@register("c6_derive_node_attributes", ETL_NODES, ("lon", "lat", "population", "productivity"),
          ctes=S.NET_T + SV.RAW)
def c6_derive_node_attributes(spark, sf_dir):
    from arcweave.plans.etl import derive_node_attributes
    raw_nodes, _, _ = VA.raw_tables(spark, sf_dir)
    return derive_node_attributes(raw_nodes)


def _etl_edges_sql():
    speed = S.finite("CASE WHEN dur_h <> 0 THEN dist_km / dur_h END")
    return f"""
    SELECT edge_id, "from", "to", {_r7('delta_i0')} AS delta_i,
           {_r7(S.iceberg('dist_km', 0.0))} AS delta_tau, {_r7('speed')} AS Ijk,
           {_r7('speed')} AS Il, {_r7('iu')} AS Iu
    FROM (SELECT *, CASE WHEN iu - speed < 1e-4 OR di IS NULL THEN 0.0 ELSE di END AS delta_i0
          FROM (SELECT *, {S.finite('CASE WHEN iu - speed <> 0 THEN total / (iu - speed) END')}
                       AS di
                FROM (SELECT *, greatest(speed, 90.0) AS iu
                      FROM (SELECT *, {speed} AS speed, ug_cost_km * dist_km / 1e6 AS total
                            FROM (SELECT *, distance / 1000 AS dist_km, duration / 60 AS dur_h
                                  FROM raw_edges) a) b) c) d) e"""


@register("c5_derive_edge_attributes", _etl_edges_sql(),
          ("delta_i", "delta_tau", "Ijk", "Il", "Iu"), ctes=S.NET_T + SV.RAW)
def c5_derive_edge_attributes(spark, sf_dir):
    _, raw_edges, _ = VA.raw_tables(spark, sf_dir)
    edges, _ = derive_edge_attributes(raw_edges)
    return edges


_ETL_FINDINGS = """
    SELECT 'error' AS severity, 'C5' AS rule, 'edges' AS entity, edge_id AS key,
           'Edge ' || CAST("from" AS VARCHAR) || ' - ' || CAST("to" AS VARCHAR) ||
           ': speed is not finite and positive.' AS message
    FROM raw_edges WHERE duration = 0
    UNION ALL
    SELECT 'error', 'D3', 'edges', edge_id,
           'no geometry for ' || CAST("from" AS VARCHAR) || '/' || CAST("to" AS VARCHAR)
    FROM raw_edges e WHERE NOT EXISTS (SELECT 1 FROM raw_geometry g
                                       WHERE g."from" = e."from" AND g."to" = e."to")"""
_ETL = [("etl_nodes", ETL_NODES), ("etl_edges", f"""
    SELECT e.*, g.geometry FROM ({_etl_edges_sql()}) e
    LEFT JOIN (SELECT "from", "to", min(geometry) AS geometry FROM raw_geometry
               GROUP BY "from", "to") g ON g."from" = e."from" AND g."to" = e."to" """)]


@register("f6_etl_findings", _ETL_FINDINGS, ctes=S.NET_T + SV.RAW)
def f6_etl_findings(spark, sf_dir):
    _, findings = build_network_from_raw(*VA.raw_tables(spark, sf_dir, paired=True))
    return findings


@register("f6_etl_network_edges", "SELECT * FROM etl_edges", ("Ijk", "delta_i", "delta_tau", "Il", "Iu"),
          ctes=S.NET_T + SV.RAW + _ETL)
def f6_etl_network_edges(spark, sf_dir):
    net, _ = build_network_from_raw(*VA.raw_tables(spark, sf_dir, paired=True))
    return net.edges.select("edge_id", "from", "to", "delta_i", "delta_tau", "Ijk", "Il", "Iu", "geometry")


@register("f6_etl_network_nodes", "SELECT * FROM etl_nodes", ("lon", "lat", "population", "productivity"),
          ctes=S.NET_T + SV.RAW + _ETL)
def f6_etl_network_nodes(spark, sf_dir):
    net, _ = build_network_from_raw(*VA.raw_tables(spark, sf_dir, paired=True))
    return net.nodes


@register("f6_validated_network", f"{_ETL_FINDINGS} UNION ALL {validate_sql('etl_nodes', 'etl_edges')}",
          ctes=S.NET_T + SV.RAW + _ETL + T_COMP)
def f6_validated_network(spark, sf_dir):
    """Findings of the derivation and of the whole validation of the built network."""
    _, findings = build_validated_network(*VA.raw_tables(spark, sf_dir, paired=True), scratch_dir(spark, "etl"))
    return findings


_GOOD = [("gedges", 'SELECT * FROM tedges WHERE ("from" + "to") % 17 <> 0 AND ("from" + "to") % 53 <> 0'),
         ("garcs", 'SELECT "from" AS src, "to" AS dst FROM gedges UNION ALL SELECT "to", "from" FROM gedges'),
         ("greach(node, lbl)", """SELECT node, node FROM tnodes
             UNION SELECT a.dst, r.lbl FROM greach r JOIN garcs a ON a.src = r.node"""),
         ("gcomp", "SELECT node, min(lbl) AS component FROM greach GROUP BY node")]


@register("f6_validated_summary", """
    SELECT CAST(0 AS BIGINT) AS n_errors,
           1 + (SELECT CAST(count(*) > 0 AS BIGINT) FROM gedges WHERE geometry LIKE 'POINT%')
             + (SELECT CAST(max(component) > 1 AS BIGINT) FROM gcomp) AS n_warnings, true AS valid""",
          ctes=S.NET_T + _GOOD)
def f6_validated_summary(spark, sf_dir):
    """Raw tables without the edges that have no speed or no geometry: a valid network.

    Warnings: no housing, texts that are no line, nodes that are not reached."""
    raw_nodes, raw_edges, raw_geometry = VA.raw_tables(spark, sf_dir, paired=True)
    s = F.col("from") + F.col("to")
    good = raw_edges.filter((s % 53 != 0) & (s % 17 != 0))
    _, findings = build_validated_network(raw_nodes, good, raw_geometry, scratch_dir(spark, "etl"))
    return V.findings_summary(findings)


# ---------------------------------------------------------------- scenarios

PARAM_COLS = M.NUMERIC + M.FLAGS


def _c19_sql():
    pre = M.ROAD_PRESET
    cols = []
    for f in PARAM_COLS:
        typ = "DOUBLE" if f in M.NUMERIC else "BOOLEAN"
        own = f if f in ("alpha", "beta", "gamma", "rho", "K", "tol", "min_iter", "max_iter",
                         "sigma", "a", "nu", "labor_mobility", "annealing", "duality",
                         "allow_downgrade", "productivity_floor") else "NULL"
        pv = pre.get(f)
        pv_sql = "NULL" if pv is None else (str(pv).lower() if isinstance(pv, bool) else repr(pv))
        dv = M.PARAM_DEFAULTS[f]
        dv_sql = str(dv).lower() if isinstance(dv, bool) else repr(dv)
        expr = (f"coalesce(CASE WHEN preset = 'road' THEN CAST({pv_sql} AS {typ}) END, "
                f"CAST({own} AS {typ}), CAST({dv_sql} AS {typ}))")
        if f in ("min_iter", "max_iter"):
            expr = f"CAST(round_even({expr}, 0) AS BIGINT)"
        cols.append(f"{expr} AS {f}")
    return (f"SELECT scenario_id, {', '.join(cols)}, pow(10.0, -tol_) AS tol_value, "
            f"K_ * 2 AS K_model FROM (SELECT *, "
            f"coalesce(CASE WHEN preset = 'road' THEN CAST({pre['tol']!r} AS DOUBLE) END, tol) "
            f"AS tol_, K AS K_ FROM scen) s")


@register("c19_derive_params", _c19_sql(),
          ("alpha", "beta", "gamma", "rho", "K", "tol", "sigma", "a", "nu", "tol_value",
           "K_model"), ctes=SV.SCENARIOS)
def c19_derive_params(spark, sf_dir):
    return M.derive_params(VA.scenario_table(spark, sf_dir), M.presets_table(spark))


def _b20_sql():
    p = f"({_c19_sql()}) p"
    rules = [
        ("warning", "gamma > beta AND NOT annealing", "gamma above beta without annealing"),
        ("error", "duality AND (labor_mobility OR beta > 1)",
         "duality with mobile labour or beta above 1"),
        ("error", "a > 1", "a above 1"),
        ("error", "nu < 1", "nu below 1"),
        ("error", "alpha <= 0 OR alpha >= 1", "alpha not between 0 and 1"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{sev}' AS severity, 'B20' AS rule, 'scenarios' AS entity, scenario_id AS key, "
        f"'scenario ' || CAST(scenario_id AS VARCHAR) || ': {msg}' AS message FROM {p} "
        f"WHERE {cond}" for sev, cond, msg in rules)


@register("b20_check_params", _b20_sql(), ctes=SV.SCENARIOS)
def b20_check_params(spark, sf_dir):
    return V.check_params(M.derive_params(VA.scenario_table(spark, sf_dir),
                                          M.presets_table(spark)))


@register("d8_sweep_model_arcs", f"""
    SELECT p.scenario_id, a.src, a.dst, a.I0,
           CASE WHEN a.Il IS NOT NULL THEN least(a.Il, a.I0) WHEN p.allow_downgrade
                THEN CAST(0 AS DOUBLE) ELSE a.I0 END AS Il,
           CASE WHEN a.Iu IS NOT NULL THEN greatest(a.Iu, a.I0) END AS Iu
    FROM (SELECT "from" AS src, "to" AS dst, Ijk AS I0, Il, Iu FROM tedges
          UNION ALL SELECT "to", "from", Ijk, Il, Iu FROM tedges) a
    CROSS JOIN ({_c19_sql()}) p""", ("I0", "Il", "Iu"), ctes=S.NET_T + SV.SCENARIOS)
def d8_sweep_model_arcs(spark, sf_dir):
    params = M.derive_params(VA.scenario_table(spark, sf_dir), M.presets_table(spark))
    return M.sweep_model_tables(X.trade_network(spark, sf_dir), params).arcs.select(
        "scenario_id", "src", "dst", "I0", "Il", "Iu")


@register("d8_sweep_productivity", f"""
    SELECT p.scenario_id, n.node, CAST(n.good AS INTEGER) AS good,
           CASE WHEN p.productivity_floor THEN greatest(n.z, 0.001) ELSE n.z END AS z
    FROM (SELECT t.node, t.product, g.good, CASE WHEN g.good = t.product THEN t.productivity ELSE 0.0 END
                 AS z FROM tnodes t CROSS JOIN
                 (SELECT unnest(range(1, (SELECT max(product) FROM tnodes) + 1)) AS good) g) n
    CROSS JOIN ({_c19_sql()}) p
    WHERE p.productivity_floor OR n.good = n.product""",
          ("z",), ctes=S.NET_T + SV.SCENARIOS)
def d8_sweep_productivity(spark, sf_dir):
    params = M.derive_params(VA.scenario_table(spark, sf_dir), M.presets_table(spark))
    return M.sweep_model_tables(X.trade_network(spark, sf_dir), params).productivity


@register("d8_sweep_labour", f"""
    SELECT p.scenario_id, n.node, n.population AS Lj, n.population * 0.3 AS Hj
    FROM tnodes n CROSS JOIN ({_c19_sql()}) p""", ("Lj", "Hj"), ctes=S.NET_T + SV.SCENARIOS)
def d8_sweep_labour(spark, sf_dir):
    """Every node has ``housing``, so it is used in place of the population share."""
    params = M.derive_params(VA.scenario_table(spark, sf_dir), M.presets_table(spark))
    net = X.trade_network(spark, sf_dir)
    nodes = net.nodes.withColumn("housing", F.col("population") * 0.3)
    return M.sweep_model_tables(X.NetworkTables(nodes, net.edges), params).labour


@register("f3_model_from_params", f"""
    SELECT p.scenario_id, n.node, n.population AS Lj, n.population * (1 - p.alpha) AS Hj
    FROM tnodes n CROSS JOIN ({_c19_sql()}) p""", ("Lj", "Hj"), ctes=S.NET_T + SV.SCENARIOS)
def f3_model_from_params(spark, sf_dir):
    params = M.derive_params(VA.scenario_table(spark, sf_dir), M.presets_table(spark))
    return M.model_tables(X.trade_network(spark, sf_dir), params).labour


@register("d8_sweep_utility", f"""
    SELECT p.scenario_id, a.run_id, a.node,
           {S.utility('a.c_pc', '(1 - p.alpha)', 'p.alpha', 'p.rho')} AS u
    FROM talloc a CROSS JOIN ({_c19_sql()}) p""", ("u",), ctes=S.NET_T + SV.SCENARIOS)
def d8_sweep_utility(spark, sf_dir):
    params = M.derive_params(VA.scenario_table(spark, sf_dir), M.presets_table(spark))
    alloc = X.trade_allocations(spark, sf_dir).node_alloc
    s = M.sweep(alloc.select("run_id", "node", "c_pc"), params, ["alpha", "rho"])
    return s.select("scenario_id", "run_id", "node",
                    utility("c_pc", F.lit(1.0) - F.col("alpha"), "alpha", "rho").alias("u"))


# ---------------------------------------------------------------- single-function views

@register("c10_perc_upgraded_bounded", f"""
    SELECT f1."from", f1."to", f1.perc_upgraded FROM ({S.edge_table('result', edges='bnd',
    prefix='f1c')[1]}) f1""", ("perc_upgraded",),
          ctes=S.NET_T + [("bnd", "SELECT * REPLACE (CAST(100 AS DOUBLE) AS Iu) FROM tedges")]
          + S.edge_table("result", edges="bnd", prefix="f1c")[0])
def c10_perc_upgraded_bounded(spark, sf_dir):
    t = _f1(spark, sf_dir, VA.bounded_variant(spark, sf_dir))
    return t.select("from", "to", "perc_upgraded")


@register("c11_c12_gain_increase", f"""
    SELECT r.node, {S.pct_gain('r.uj', 'b.uj')} AS uj_gain_pct,
           greatest(r.c_agg - b.c_agg, 0.0) AS c_agg_increase
    FROM (SELECT * FROM talloc WHERE run_id = 'result') r
    JOIN (SELECT * FROM talloc WHERE run_id = 'baseline') b ON b.node = r.node""",
          ("uj_gain_pct", "c_agg_increase"))
def c11_c12_gain_increase(spark, sf_dir):
    from arcweave.functions import increase, pct_gain
    from arcweave.plans.results import compare_runs
    a = X.trade_allocations(spark, sf_dir).node_alloc
    r = a.filter(F.col("run_id") == "result").drop("run_id")
    b = a.filter(F.col("run_id") == "baseline").drop("run_id")
    j = compare_runs(r, b)
    return j.select("node", pct_gain("uj", "uj_orig").alias("uj_gain_pct"),
                    increase("c_agg", "c_agg_orig").alias("c_agg_increase"))


@register("d5_compare_runs", """
    SELECT r.node, r.uj, b.uj AS uj_orig, r.PCj, b.PCj AS PCj_orig
    FROM (SELECT * FROM talloc WHERE run_id = 'result') r
    JOIN (SELECT * FROM talloc WHERE run_id = 'baseline') b ON b.node = r.node""",
          ("uj", "uj_orig", "PCj", "PCj_orig"))
def d5_compare_runs(spark, sf_dir):
    from arcweave.plans.results import compare_runs
    a = X.trade_allocations(spark, sf_dir).node_alloc
    r = a.filter(F.col("run_id") == "result").select("node", "uj", "PCj")
    b = a.filter(F.col("run_id") == "baseline").select("node", "uj", "PCj")
    return compare_runs(r, b).select("node", "uj", "uj_orig", "PCj", "PCj_orig")


@register("c13_feature_properties", f"""
    SELECT node, {S.round_sig('productivity', 7)} AS productivity,
           {S.round_sig('population', 7)} AS population, name, CAST(product AS VARCHAR) AS product
    FROM tnodes""", ("productivity", "population"))
def c13_feature_properties(spark, sf_dir):
    from arcweave.plans.publish import feature_properties
    n = X.trade_nodes(spark, sf_dir).select("node", "lon", "lat", "population", "productivity",
                                            F.col("product").cast("string").alias("product"),
                                            "name")
    p = n.select("node", feature_properties(n).alias("p"))
    return p.select("node", "p.productivity", "p.population", "p.name", "p.product")


@register("c16_normalise", f"""
    SELECT "from", "to",
           CASE WHEN hi > lo THEN least(greatest((Qjk_total - lo) / (hi - lo), 0.0), 1.0)
                ELSE least(greatest((Qjk_total - lo) / 1e-9, 0.0), 1.0) END AS q_norm
    FROM f1 CROSS JOIN (SELECT min(Qjk_total) AS lo, max(Qjk_total) AS hi FROM f1) d""",
          ("q_norm",), ctes=S.NET_T + F1C + [("f1", F1F)])
def c16_normalise(spark, sf_dir):
    from arcweave.functions import normalise, widen_domain
    t = _f1(spark, sf_dir)
    d = F.broadcast(t.agg(F.min("Qjk_total").alias("lo"), F.max("Qjk_total").alias("hi")))
    return t.crossJoin(d).select(
        "from", "to", normalise("Qjk_total", "lo", widen_domain("lo", "hi")).alias("q_norm"))
