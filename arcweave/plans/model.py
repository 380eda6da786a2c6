"""Model tables (F3), scenario parameters (C19) and scenario sweeps.

Parameters are rows of a scenario table, not driver-side constants, so one job
evaluates any number of scenarios: every row of the network meets every scenario
(``attach_rows``) and ``scenario_id`` joins every key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.util import finite_or_null
from arcweave.operators.arcs import (PAIR, effective_bounds, effective_housing, housing_policy,
                                     productivity_long, to_arcs)
from arcweave.operators.util import attach_rows
from arcweave.sources.fixtures import NetworkTables

# Parameter defaults of the reference's form, and the named
# calibration preset that overrides some of them.
PARAM_DEFAULTS = {
    "alpha": 0.5, "beta": 1.0, "gamma": 1.0, "rho": 0.0, "K": 1.0, "tol": 5.0,
    "min_iter": 20.0, "max_iter": 200.0, "sigma": 5.0, "a": 0.8, "nu": 2.0,
    "labor_mobility": False, "cross_good_congestion": False, "annealing": True,
    "duality": True, "compute_baseline": True, "allow_downgrade": False,
    "productivity_floor": True,
}
ROAD_PRESET = {
    "alpha": 0.7, "beta": 1.0, "gamma": 1.2, "rho": 0.0, "sigma": 3.8, "a": 1.0, "nu": 2.0,
    "cross_good_congestion": False, "annealing": False, "duality": True, "tol": 5.0,
    "min_iter": 15.0, "max_iter": 45.0, "productivity_floor": True,
}
NUMERIC = ["alpha", "beta", "gamma", "rho", "K", "tol", "min_iter", "max_iter", "sigma", "a", "nu"]
FLAGS = ["labor_mobility", "cross_good_congestion", "annealing", "duality", "compute_baseline",
         "allow_downgrade", "productivity_floor"]
PRODUCTIVITY_FLOOR = 1e-3


def presets_table(spark: SparkSession) -> DataFrame:
    """The named presets as a table ``(preset, <field>...)``; absent fields are null."""
    fields = NUMERIC + FLAGS
    schema = ("preset string, " + ", ".join(f"{f} double" for f in NUMERIC) + ", "
              + ", ".join(f"{f} boolean" for f in FLAGS))
    row = ["road"] + [ROAD_PRESET.get(f) for f in fields]
    return spark.createDataFrame([tuple(row)], schema)


def derive_params(scenarios: DataFrame, presets: DataFrame | None = None) -> DataFrame:
    """One row per scenario with every field resolved.

    Precedence: preset value (when the scenario names a preset) over the
    scenario's own value over the default. ``tol`` digits become ``10^-tol``,
    iteration counts are rounded half to even, and ``K_model = 2K``.
    """
    s = scenarios
    if presets is not None and "preset" in s.columns:
        p = presets.select("preset", *[F.col(f).alias(f"p_{f}") for f in NUMERIC + FLAGS])
        s = s.join(p, "preset", "left")
    cols = [F.col("scenario_id")]
    for f in NUMERIC + FLAGS:
        own = F.col(f) if f in scenarios.columns else F.lit(None)
        pre = F.col(f"p_{f}") if f"p_{f}" in s.columns else F.lit(None)
        typ = "double" if f in NUMERIC else "boolean"
        cols.append(F.coalesce(pre.cast(typ), own.cast(typ),
                               F.lit(PARAM_DEFAULTS[f]).cast(typ)).alias(f))
    r = s.select(*cols)
    return (r.withColumn("tol_value", F.pow(F.lit(10.0), -F.col("tol")))
            .withColumn("min_iter", F.bround("min_iter", 0).cast("long"))
            .withColumn("max_iter", F.bround("max_iter", 0).cast("long"))
            .withColumn("K_model", F.col("K") * 2))


@dataclass
class ModelTables:
    arcs: DataFrame          # (scenario_id?, src, dst, delta_i, delta_tau, I0, Il, Iu)
    productivity: DataFrame  # (scenario_id?, node, good, z)
    labour: DataFrame        # (scenario_id?, node, Lj, Hj)


def model_tables(net: NetworkTables, params: DataFrame | None = None,
                 allow_downgrade: bool = False, floor: float | None = None,
                 alpha: float = 0.5) -> ModelTables:
    """directed arcs with effective bounds (G1 + C7), node × good productivity
    (D7), labour and housing (C8).

    Arcs of edges that store their pair keep it. Without ``params`` the scalar arguments apply; a scenario table (one row or many) gives
    tables keyed by ``scenario_id`` with its flags and ``alpha`` (``sweep_model_tables``).
    """
    if params is not None:
        return sweep_model_tables(net, params)
    edges = net.edges.select("from", "to", "delta_i", "delta_tau", "Ijk",
                             *[c for c in ("Il", "Iu", *PAIR) if c in net.edges.columns])
    arcs = to_arcs(effective_bounds(edges, allow_downgrade)).select(
        "src", "dst", "delta_i", "delta_tau", F.col("Ijk").alias("I0"),
        F.col("Il_eff").alias("Il"), F.col("Iu_eff").alias("Iu"), *[c for c in PAIR if c in edges.columns])
    prod = productivity_long(net.nodes, floor=floor)
    lab = effective_housing(net.nodes, alpha).select(
        "node", F.col("population").alias("Lj"), "Hj")
    return ModelTables(arcs, prod, lab)


def sweep_model_tables(net: NetworkTables, params: DataFrame) -> ModelTables:
    """D8 + F3: model tables for every scenario at once, keyed by ``scenario_id``.

    Downgrading, the productivity floor and ``alpha`` are evaluated per row. Only scenarios
    with the floor get all goods of a node; the others its own good. ``housing`` is used as in
    ``effective_housing``.
    """
    sc = params.select("scenario_id", "allow_downgrade", "productivity_floor", "alpha")
    edges = net.edges
    # as in ``effective_bounds``: a non-finite bound means unbounded / no value
    il = finite_or_null(F.col("Il")) if "Il" in edges.columns else F.lit(None).cast("double")
    iu = finite_or_null(F.col("Iu")) if "Iu" in edges.columns else F.lit(None).cast("double")
    e = attach_rows(edges.select("from", "to", "delta_i", "delta_tau", "Ijk", il.alias("Il"),
                                 iu.alias("Iu")), sc)
    ijk = F.col("Ijk")
    e = e.select("scenario_id", "from", "to", "delta_i", "delta_tau", "Ijk",
                 F.when(F.col("Il").isNotNull(), F.least("Il", ijk))
                 .when(F.col("allow_downgrade"), F.lit(0.0)).otherwise(ijk).alias("Il_eff"),
                 F.when(F.col("Iu").isNotNull(), F.greatest("Iu", ijk)).alias("Iu_eff"))
    arcs = to_arcs(e).select("scenario_id", "src", "dst", "delta_i", "delta_tau",
                             F.col("Ijk").alias("I0"), F.col("Il_eff").alias("Il"),
                             F.col("Iu_eff").alias("Iu"))
    nodes = net.nodes
    own = (F.col("product") if "product" in nodes.columns else F.lit(1)).cast("int").alias("own")
    n_goods = F.broadcast(nodes.agg(F.max(own).alias("_n_goods")))  # one row
    facts = nodes.select("node", own, "productivity").crossJoin(n_goods)
    every = attach_rows(facts, sc.select("scenario_id", "productivity_floor"))
    goods = F.when(F.col("productivity_floor"), F.sequence(F.lit(1), F.col("_n_goods"))).otherwise(
        F.array("own"))
    z_own = F.when(F.col("good") == F.col("own"), F.col("productivity")).otherwise(F.lit(0.0))
    prod = every.withColumn("good", F.explode(goods)).select(
        "scenario_id", "node", "good",
        F.when(F.col("productivity_floor"), F.greatest(z_own, F.lit(PRODUCTIVITY_FLOOR)))
        .otherwise(z_own).alias("z"))
    housing = F.col("housing") if "housing" in nodes.columns else F.lit(None).cast("double")
    homes = (nodes.select("node", "population", housing.alias("housing"))
             .crossJoin(F.broadcast(housing_policy(nodes))))  # one row
    lab = attach_rows(homes, sc.select("scenario_id", "alpha")).select(
        "scenario_id", "node", F.col("population").alias("Lj"),
        F.when(F.col("housing_ok"), F.col("housing"))
        .otherwise(F.col("population") * (F.lit(1.0) - F.col("alpha"))).alias("Hj"))
    return ModelTables(arcs, prod, lab)


def sweep(df: DataFrame, params: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Evaluate any per-row operator for many scenarios: every row meets every scenario;
    callers add ``scenario_id`` to every key."""
    p = params.select("scenario_id", *(cols or [c for c in params.columns
                                               if c != "scenario_id"]))
    return attach_rows(df, p)
