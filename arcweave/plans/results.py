"""Result tables (F1, F2) and run comparisons.

F1 plan shape: the two fact tables (``arc_infra`` and ``arc_flow``) are each
pre-aggregated on the canonical pair, with map-side partial
aggregation so hot pairs are combined before the exchange, and joined to the
edge list on the same key. Where all three are stored bucketed by the pair
(``arcweave.sources.buckets``), none of them is exchanged. The cap is a one-row
aggregate of the edges, attached by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions import finite_or_null, increase, pct_gain, perc_upgraded
from arcweave.operators.aggregates import edge_flows_wide, node_production
from arcweave.operators.arcs import symmetrise, with_pair
from arcweave.operators.validate import drop_incomplete_housing
from arcweave.sources.fixtures import NetworkTables

EDGE_INPUT_COLS = ["from", "to", "delta_i", "delta_tau", "Ijk_orig"]


def edge_inputs(edges: DataFrame) -> DataFrame:
    """F1 without a run: the input columns only."""
    return edges.select("from", "to", F.col("delta_i").cast("double"),
                        F.col("delta_tau").cast("double"),
                        F.col("Ijk").cast("double").alias("Ijk_orig"))


def edge_facts(edges: DataFrame, arc_infra: DataFrame, arc_flow: DataFrame | None = None, n_goods: int = 1,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """F1 without the columns that depend on the whole network: input columns, ``Iu``, the canonical pair,
    ``Ijk``, and with flows ``Qjk_*``. Rows depend only on the arcs of their own pair."""
    infra = symmetrise(arc_infra, ["ijk"]).withColumnRenamed("ijk", "ijk_sym")
    out = (edge_base(edges, keep).join(infra, ["pair_lo", "pair_hi"], "left")
           .withColumn("Ijk", F.coalesce(F.col("ijk_sym"), F.lit(0.0))).drop("ijk_sym"))
    if arc_flow is None:
        return out
    flows = edge_flows_wide(arc_flow, n_goods)
    qcols = [c for c in flows.columns if c.startswith("Qjk_")]
    out = out.join(flows, ["pair_lo", "pair_hi"], "left")
    return out.select(*[c for c in out.columns if c not in qcols],
                      *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in qcols])


def edge_base(edges: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Input columns, ``Iu`` (null where the table has none) and the canonical pair."""
    return with_pair(edges).select(*keep, *EDGE_INPUT_COLS[:4], F.col("Ijk").cast("double").alias("Ijk_orig"),
                                   (F.col("Iu").cast("double") if "Iu" in edges.columns
                                    else F.lit(None).cast("double")).alias("Iu"),
                                   "pair_lo", "pair_hi")


def with_upgrades(facts: DataFrame, cap: DataFrame) -> DataFrame:
    """``increase`` and ``perc_upgraded`` beside ``Ijk``, from the one-row frame ``cap``."""
    at = facts.columns.index("Ijk") + 1
    out = facts.crossJoin(F.broadcast(cap)).withColumns({  # one row
        "increase": increase("Ijk", "Ijk_orig"),
        "perc_upgraded": perc_upgraded("Ijk", "Ijk_orig", "Iu", "cap")})
    return out.select(*facts.columns[:at], "increase", "perc_upgraded", *facts.columns[at:]).drop(
        "Iu", "pair_lo", "pair_hi")


def network_cap(edges: DataFrame, arc_infra: DataFrame) -> DataFrame:
    """E5: the largest finite ``Iu``, or else the largest old or new infrastructure of an edge.

    The new infrastructure needs the join with the arcs, which is made only where no edge has a finite bound:
    one look for such an edge, which ends at the first, decides.
    """
    base = edge_base(edges)
    bounded = finite_or_null(F.col("Iu"))
    if not base.filter(bounded.isNotNull()).isEmpty():
        return base.agg(F.max(bounded).alias("cap"))
    return edge_facts(edges, arc_infra).agg(F.greatest(F.max("Ijk_orig"), F.max("Ijk")).alias("cap"))


def edge_table(net: NetworkTables, arc_infra: DataFrame | None = None,
               arc_flow: DataFrame | None = None, run_id: str | None = "result",
               n_goods: int = 1, keep: tuple[str, ...] = (), cap: DataFrame | None = None) -> DataFrame:
    """edge result table.

    Inputs only without a run; with a run adds ``Ijk`` (mean of both directions),
    ``increase``, ``perc_upgraded`` and, with flows, ``Qjk_1..Qjk_N`` (N > 1) and
    ``Qjk_total``. ``keep`` carries extra edge columns (e.g. ``edge_id``, ``line``).
    ``cap`` is the ``network_cap`` of the run where the caller has it, as from edges without those columns.
    """
    if arc_infra is None:
        return edge_base(net.edges, keep).drop("Iu", "pair_lo", "pair_hi")
    if run_id is not None:
        arc_infra = arc_infra.filter(F.col("run_id") == run_id)
        arc_flow = None if arc_flow is None else arc_flow.filter(F.col("run_id") == run_id)
    return with_upgrades(edge_facts(net.edges, arc_infra, arc_flow, n_goods, keep),
                         network_cap(net.edges, arc_infra) if cap is None else cap)


NODE_ALLOC_COLS = ["uj", "c_pc", "c_agg", "PCj", "Lj"]
GAIN_COLS = ["uj", "c_pc", "c_agg", "PCj"]


def node_inputs(nodes: DataFrame) -> DataFrame:
    """Input columns of the node table; ``housing`` with gaps is not used."""
    nodes = drop_incomplete_housing(nodes)
    cols = [F.col("node"), F.col("lon"), F.col("lat"),
            F.col("population").cast("double"), F.col("productivity").cast("double")]
    for c in ("housing", "product", "name"):
        if c in nodes.columns:
            cols.append(F.col(c))
    return nodes.select(*cols)


def _run_columns(node_alloc: DataFrame, node_output: DataFrame | None, run_id: str,
                 suffix: str) -> DataFrame:
    alloc = node_alloc.filter(F.col("run_id") == run_id).select(
        "node", *[F.col(c).alias(c + suffix) for c in NODE_ALLOC_COLS])
    if node_output is None:
        return alloc
    prod = node_production(node_output.filter(F.col("run_id") == run_id), keys=()).select(
        "node", F.col("Yj").alias("Yj" + suffix))
    return alloc.join(prod, "node", "left")


def node_table(net: NetworkTables, node_alloc: DataFrame | None = None,
               node_output: DataFrame | None = None, run_id: str = "result",
               baseline_id: str | None = "baseline") -> DataFrame:
    """node result table: inputs, run outcomes, ``_orig`` baseline columns and gains.

    The gain columns ``*_gain_pct`` are computed for ``uj, c_pc, c_agg, PCj``.
    Runs are joined on ``node`` (D5); each run side is one filtered scan.
    """
    out = node_inputs(net.nodes)
    if node_alloc is None:
        return out
    if baseline_id is not None:
        out = out.join(_run_columns(node_alloc, node_output, baseline_id, "_orig"), "node", "left")
    out = out.join(_run_columns(node_alloc, node_output, run_id, ""), "node", "left")
    if baseline_id is not None:
        out = out.select("*", *[pct_gain(c, c + "_orig").alias(c + "_gain_pct")
                                for c in GAIN_COLS])
    return out


def compare_runs(result: DataFrame, baseline: DataFrame | None, key: str = "node") -> DataFrame:
    """Baseline columns renamed ``x_orig`` next to the result's ``x``; left join if no baseline."""
    if baseline is None:
        return result
    b = baseline.select(key, *[F.col(c).alias(c + "_orig") for c in baseline.columns if c != key])
    return result.join(b, key, "inner")


def run_diff(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long difference of two runs: ``keys, metric, a, b, diff, pct``.

    A full outer join keeps rows present in only one run.
    """
    av = a.select(*keys, *[F.col(m).cast("double").alias(f"a_{m}") for m in metrics])
    bv = b.select(*keys, *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics])
    j = av.join(bv, keys, "full_outer")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("a"),
                              F.col(f"b_{m}").alias("b")) for m in metrics])
    long = j.select(*keys, F.inline(rows))
    return long.select(*keys, "metric", "a", "b", (F.col("b") - F.col("a")).alias("diff"),
                       pct_gain("b", "a").alias("pct"))
