"""Aggregations (section 2E).

Scalars (caps, budgets, domains) stay one-row DataFrames that are attached with a
broadcast cross join; they are never collected and re-injected as literals.
Several statistics over one table are computed in a single ``agg`` pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions import (finite_or_null, pct_gain, round_sig, transform_value,
                                widen_domain)
from arcweave.functions.sums import exact_sums
from arcweave.operators.arcs import arc_weight, pair_columns

# ---------------------------------------------------------------- budget


def budget_stats(edges: DataFrame) -> DataFrame:
    """One row ``K_base, K_max, K_suggested``.

    ``K_max`` is null unless every ``Iu`` is present and finite. The suggestion is
    ``min(1.2·K_base, K_base + 0.5·(K_max − K_base))`` (or ``1.2·K_base``), 4 significant digits.
    """
    iu = F.col("Iu") if "Iu" in edges.columns else F.lit(None).cast("double")
    iu_ok = iu.isNotNull() & ~F.isnan(iu) & (F.abs(iu) != F.lit(float("inf")))
    stats = exact_sums(edges, {
        "K_base": F.col("delta_i") * F.col("Ijk"), "_k_max": F.col("delta_i") * F.greatest(iu, F.col("Ijk")),
        "_no_iu": F.when(~iu_ok, F.lit(1.0))})
    k_max = F.when(F.col("_no_iu").isNull(), F.col("_k_max"))
    k_base = F.col("K_base")
    raw = F.when(k_max.isNull(), k_base * 1.2).otherwise(
        F.least(k_base * 1.2, k_base + F.lit(0.5) * (k_max - k_base)))
    return stats.select("K_base", k_max.alias("K_max"), round_sig(raw, 4).alias("K_suggested"))


def budget_spent(arcs: DataFrame, infra_col: str = "ijk") -> DataFrame:
    """``Σ δi·I`` over the arc table (twice the edge-list sum); the same bits for any partitioning."""
    return exact_sums(arcs, {"spent": F.col("delta_i") * F.col(infra_col)})


def rescale_to_budget(arcs: DataFrame, K, infra_col: str = "ijk") -> DataFrame:
    """Scale infrastructure so ``Σ δi·I`` over arcs equals ``K`` exactly.

    ``K`` is a number or a one-row frame with column ``K``. The global sum is a
    one-row frame attached by broadcast cross join; no value reaches the driver.
    """
    spent = budget_spent(arcs, infra_col)
    if isinstance(K, DataFrame):
        scal = spent.crossJoin(K.agg(F.max("K").alias("K")))  # one row each
    else:
        scal = spent.withColumn("K", F.lit(float(K)))
    factor = F.try_divide(F.col("K"), F.col("spent"))
    return (arcs.crossJoin(F.broadcast(scal))
            .withColumn(infra_col, F.col(infra_col) * factor)
            .drop("spent", "K"))


# ---------------------------------------------------------------- edges


def global_cap(edges: DataFrame, new_col: str = "Ijk", old_col: str = "Ijk_orig") -> DataFrame:
    """E5: one row ``cap``: max finite ``Iu``; else max of new and old infrastructure."""
    iu = F.col("Iu") if "Iu" in edges.columns else F.lit(None).cast("double")
    iu_f = finite_or_null(iu)
    return edges.agg(F.coalesce(F.max(iu_f),
                                F.greatest(F.max(new_col), F.max(old_col))).alias("cap"))


def edge_flows_long(arc_flow: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Symmetrised flow per undirected pair and good: ``(pair_lo, pair_hi, good, q)``."""
    return arc_flow.groupBy(*keys, *pair_columns(arc_flow), "good").agg(
        F.sum(F.col("q") * arc_weight()).alias("q"))


def edge_flows_wide(arc_flow: DataFrame, n_goods: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """E7 + E8 in one pass: ``Qjk_1..Qjk_N`` (only when N > 1) and ``Qjk_total`` per pair.

    The pivot values are known (1..N), so this is one conditional aggregation —
    one shuffle on the pair key, no extra pass to discover the pivot values.
    """
    wq = F.col("q") * arc_weight()
    aggs = []
    if n_goods > 1:
        aggs = [F.sum(F.when(F.col("good") == g, wq).otherwise(F.lit(0.0))).alias(f"Qjk_{g}")
                for g in range(1, n_goods + 1)]
    aggs.append(F.sum(wq).alias("Qjk_total"))
    return arc_flow.groupBy(*keys, *pair_columns(arc_flow)).agg(*aggs)


def edge_flow_total(flows_long: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total symmetrised flow per pair from the long table."""
    return flows_long.groupBy(*keys, "pair_lo", "pair_hi").agg(F.sum("q").alias("Qjk_total"))


# ---------------------------------------------------------------- nodes


def node_production(node_output: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``Yj = Σ_goods y`` per node."""
    return node_output.groupBy(*keys, "node").agg(F.sum("y").alias("Yj"))


def ces_aggregate(df: DataFrame, keys: list[str], value: str, sigma,
                  out: str = "c_agg") -> DataFrame:
    """``(Σ c^((σ−1)/σ))^(σ/(σ−1))`` per key. ``sigma`` is a number or a column."""
    sigma_c = F.lit(float(sigma)) if not isinstance(sigma, Column) else sigma
    e = (sigma_c - F.lit(1.0)) / sigma_c
    extra = [] if not isinstance(sigma, Column) else [F.first(e).alias("_e")]
    agg = df.groupBy(*keys).agg(F.sum(F.pow(F.col(value), e)).alias("_s"), *extra)
    e_final = F.col("_e") if extra else e
    return agg.select(*keys, finite_or_null(F.pow("_s", F.lit(1.0) / e_final)).alias(out))


def congestion_aggregate(arc_flow: DataFrame, weights: DataFrame | None, nu: float,
                         keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Cross-good congestion ``(Σ m_n·Q_n^ν)^(1/ν)`` per arc.

    ``weights`` is ``(good, m)`` (one row per good); without it every m is 1.
    """
    df = arc_flow
    m = F.lit(1.0)
    if weights is not None:
        df = df.join(weights, "good", "left")
        m = F.coalesce(F.col("m"), F.lit(1.0))
    return df.groupBy(*keys).agg(
        F.pow(F.sum(m * F.pow(F.col("q"), F.lit(float(nu)))), F.lit(1.0 / nu)).alias(
            "q_congestion"))


def welfare(node_alloc: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``Σ uj·Lj`` per run."""
    return exact_sums(node_alloc, {"welfare": F.col("uj") * F.col("Lj")}, keys)


def welfare_gain(welfare_df: DataFrame, result: str = "result",
                 baseline: str = "baseline") -> DataFrame:
    """One row ``welfare, welfare_baseline, welfare_gain_pct``."""
    w = welfare_df.agg(
        F.max(F.when(F.col("run_id") == result, F.col("welfare"))).alias("welfare"),
        F.max(F.when(F.col("run_id") == baseline, F.col("welfare"))).alias("welfare_baseline"))
    return w.withColumn("welfare_gain_pct", pct_gain("welfare", "welfare_baseline"))


def run_summary(welfare_row: DataFrame, info: DataFrame) -> DataFrame:
    """Welfare, baseline welfare, gain %, elapsed, K — all to 7 significant digits.

    ``info`` has ``elapsed`` and ``K``. The gain is taken between the rounded welfare values.
    """
    one = info.agg(F.max("elapsed").alias("elapsed"), F.max("K").alias("K"))
    w, w0 = round_sig("welfare", 7), round_sig("welfare_baseline", 7)
    return welfare_row.crossJoin(F.broadcast(one)).select(
        w.alias("welfare"), w0.alias("welfare_baseline"),
        round_sig(pct_gain(w, w0), 7).alias("welfare_gain_pct"),
        round_sig("elapsed", 7).alias("elapsed"),
        round_sig("K", 7).alias("K"))


# ---------------------------------------------------------------- catalogues

# Metric keys, labels and palettes in display order.
EDGE_METRICS = [
    ("Ijk", "Final infrastructure (Ijk)", "viridis"),
    ("increase", "Infrastructure increase (Ijk − initial)", "ylorrd"),
    ("perc_upgraded", "Percent upgraded (% of Iu − initial)", "ylorrd"),
    ("Qjk_total", "Total flow (all goods)", "ylorrd"),
]
EDGE_METRIC_LAST = ("Ijk_orig", "Initial infrastructure (input Ijk)", "inferno")
NODE_METRICS = [
    ("uj_gain_pct", "Welfare (utility) gain %", "rdbu", True),
    ("c_pc_gain_pct", "Consumption (per capita) gain %", "rdbu", True),
    ("PCj_gain_pct", "Price index change %", "rdbu", True),
    ("uj", "Utility per worker (uj)", "viridis", False),
    ("c_pc", "Consumption per capita (cj)", "viridis", False),
    ("c_agg", "Aggregate consumption (Cj)", "viridis", False),
    ("PCj", "Consumption price index (PCj)", "viridis", False),
    ("Lj", "Labor / population (Lj)", "viridis", False),
    ("Yj", "Production (Yj)", "viridis", False),
    ("population", "Population (input)", "viridis", False),
    ("productivity", "Productivity (input)", "viridis", False),
]
PERCENT_DOMAIN = (0.0, 100.0)


def _edge_metric_list(columns: list[str]) -> list[tuple[str, str, str, bool, tuple | None]]:
    out = []
    for key, label, pal in EDGE_METRICS:
        out.append((key, label, pal, False, PERCENT_DOMAIN if key == "perc_upgraded" else None))
    goods = sorted((c for c in columns if c.startswith("Qjk_") and c != "Qjk_total"),
                   key=lambda c: columns.index(c))
    for c in goods:
        out.append((c, f"Flow of good {c[4:]}", "ylorrd", False, None))
    key, label, pal = EDGE_METRIC_LAST
    out.append((key, label, pal, False, None))
    return [m for m in out if m[0] in columns]


def _catalogue(df: DataFrame, metrics) -> DataFrame:
    """Single aggregate pass over all metrics, then unpivot to one row per metric."""
    if not metrics:
        schema = ("position int, key string, label string, palette string, "
                  "min double, max double, diverging boolean")
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for key, *_ in metrics:
        v = finite_or_null(F.col(key).cast("double"))
        aggs += [F.min(v).alias(f"lo_{key}"), F.max(v).alias(f"hi_{key}")]
    stats = df.agg(*aggs)
    rows = []
    for pos, (key, label, pal, diverging, domain) in enumerate(metrics):
        lo, hi = F.col(f"lo_{key}"), F.col(f"hi_{key}")
        if domain is not None:
            lo_v = F.when(hi.isNotNull(), F.lit(domain[0]))
            hi_v = F.when(hi.isNotNull(), F.lit(domain[1]))
        elif diverging:
            m = F.greatest(F.abs(lo), F.abs(hi))
            lo_v, hi_v = -m, m
        else:
            lo_v, hi_v = lo, hi
        rows.append(F.struct(F.lit(pos).alias("position"), F.lit(key).alias("key"),
                             F.lit(label).alias("label"), F.lit(pal).alias("palette"),
                             round_sig(lo_v, 7).alias("min"), round_sig(hi_v, 7).alias("max"),
                             F.lit(diverging).alias("diverging"),
                             hi.isNotNull().alias("_present")))
    # Metrics whose values are all missing or non-finite are dropped.
    return (stats.select(F.inline(F.array(*rows)))
            .filter("_present").drop("_present"))


def edge_metric_catalogue(edge_df: DataFrame) -> DataFrame:
    """Edge metrics in fixed order with labels, finite min/max, percent at 0–100."""
    return _catalogue(edge_df, _edge_metric_list(edge_df.columns))


def node_metric_catalogue(node_df: DataFrame) -> DataFrame:
    """Node metrics; diverging metrics get a symmetric domain ``[-m, m]``."""
    metrics = [(k, lab, pal, div, None) for k, lab, pal, div in NODE_METRICS
               if k in node_df.columns]
    return _catalogue(node_df, metrics)


def scale_domains(df: DataFrame, metrics: dict[str, str],
                  percent: tuple[str, ...] = ("perc_upgraded",),
                  diverging: tuple[str, ...] = ()) -> DataFrame:
    """One row with ``lo_<m>, hi_<m>`` per metric over transformed finite values.

    Percent metrics at level use 0–100; diverging metrics at level use ``[-m, m]``.
    ``hi`` is widened by 1e-9 when the range is degenerate. All domains in one pass.
    """
    aggs = []
    for key, tf in metrics.items():
        t = finite_or_null(transform_value(F.col(key).cast("double"), tf))
        aggs += [F.min(t).alias(f"lo_{key}"), F.max(t).alias(f"hi_{key}")]
    stats = df.agg(*aggs)
    cols = []
    for key, tf in metrics.items():
        lo, hi = F.col(f"lo_{key}"), F.col(f"hi_{key}")
        if tf == "level" and key in percent:
            lo, hi = F.lit(0.0), F.lit(100.0)
        elif tf == "level" and key in diverging:
            m = F.greatest(F.abs(lo), F.abs(hi))
            lo, hi = -m, m
        lo = F.coalesce(lo, F.lit(0.0))
        hi = F.coalesce(hi, F.lit(1.0))
        cols += [lo.alias(f"lo_{key}"), widen_domain(lo, hi).alias(f"hi_{key}")]
    return stats.select(*cols)


PAD_FRACTION = 0.15


def bounding_box(nodes: DataFrame | None, edges: DataFrame | None = None,
                 line_col: str = "line", pad: float = PAD_FRACTION) -> DataFrame:
    """One row ``min_lon, min_lat, max_lon, max_lat`` padded by ``pad`` of the span per side.

    Uses node coordinates; with no nodes, the vertices of the edge lines. Lines are not exploded and null lines
    not filtered: Spark pushes what both ask of a line below its column, where the text would be parsed anew each time.
    """
    if nodes is not None:
        b = nodes.agg(F.min("lon").alias("a"), F.min("lat").alias("b"),
                      F.max("lon").alias("c"), F.max("lat").alias("d"), F.count(F.lit(1)).alias("n"))
    else:
        line = F.col(line_col)
        n = F.when(line.isNotNull(), F.size(line)).otherwise(F.lit(0)).cast("long")
        b = edges.agg(F.min(F.array_min(line["lon"])).alias("a"), F.min(F.array_min(line["lat"])).alias("b"),
                      F.max(F.array_max(line["lon"])).alias("c"), F.max(F.array_max(line["lat"])).alias("d"),
                      F.coalesce(F.sum(n), F.lit(0)).alias("n"))
    dlon = (F.col("c") - F.col("a")) * pad
    dlat = (F.col("d") - F.col("b")) * pad
    return b.select((F.col("a") - dlon).alias("min_lon"), (F.col("b") - dlat).alias("min_lat"),
                    (F.col("c") + dlon).alias("max_lon"), (F.col("d") + dlat).alias("max_lat"),
                    F.col("n").alias("n_points"))
