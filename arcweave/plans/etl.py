"""Raw-data ETL (C5, C6, D3, F6): raw node, edge and geometry tables -> a network.

Units: raw distance in metres, duration in minutes, population in persons,
GDP in currency units, upgrade cost per km. Output values are rounded to 7
significant digits, as the published network files are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions import finite_or_null, iceberg_cost, round_sig
from arcweave.operators.arcs import PAIR
from arcweave.operators.joins import attach_geometry, stores_pair
from arcweave.operators.validate import FINDING_COLUMNS, union_findings
from arcweave.operators.windows import sequence_number
from arcweave.plans.validation import validate_network
from arcweave.sources.buckets import write_dealt
from arcweave.sources.fixtures import NetworkTables

# Fixed values of the derivation.
TARGET_SPEED = 90.0       # km/h: upgrade target and upper bound
GAP_MIN = 1e-4            # below this speed gap the upgrade cost is 0
PORT_BOOST = 2.1          # productivity boost per outflow per person (thousands)
FLOOR = 1e-3              # population and productivity floor
SIG = 7


def derive_node_attributes(raw: DataFrame, order_col: str = "row_order") -> DataFrame:
    """Population in thousands (0 -> 1e-3), GDP per capita (0 without people),
    port boost ``2.1·outflow/pop`` and a floor of 1e-3; ``node`` = position in
    ``order_col`` order (1..n, distributed numbering)."""
    pop = F.col("population") / 1000
    out = F.col("outflows") / 1000
    prod0 = F.when(pop > 0, F.try_divide(F.col("gdp"), pop) / 1e6).otherwise(F.lit(0.0))
    pop1 = F.when(pop == 0, F.lit(FLOOR)).otherwise(pop)
    prod1 = F.when(out > 0, prod0 + F.lit(PORT_BOOST) * out / pop1).otherwise(prod0)
    prod2 = F.greatest(prod1, F.lit(FLOOR))
    numbered = sequence_number(raw, [order_col], "node")
    return numbered.select(
        F.col("node").cast("long").alias("node"), "lon", "lat",
        round_sig(pop1, SIG).alias("population"), round_sig(prod2, SIG).alias("productivity"),
        F.col("product").cast("int").alias("product"),
        F.col("city_country").alias("name"))


def derive_edge_attributes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Speed as infrastructure, 90 km/h upgrade target, upgrade cost per unit.

    Returns (edges, findings); a speed that is not finite and positive is an error.
    """
    dist_km = F.col("distance") / 1000
    dur_h = F.col("duration") / 60
    speed = finite_or_null(F.try_divide(dist_km, dur_h))
    total = F.col("ug_cost_km") * dist_km / 1e6
    iu = F.greatest(speed, F.lit(TARGET_SPEED))
    gap = iu - speed
    di = finite_or_null(F.try_divide(total, gap))
    delta_i = F.when((gap < GAP_MIN) | di.isNull(), F.lit(0.0)).otherwise(di)
    e = raw.select("edge_id", "from", "to", speed.alias("_speed"),
                   round_sig(delta_i, SIG).alias("delta_i"),
                   round_sig(iceberg_cost(dist_km, 0.0), SIG).alias("delta_tau"),
                   round_sig(speed, SIG).alias("Ijk"), round_sig(speed, SIG).alias("Il"),
                   round_sig(iu, SIG).alias("Iu"), *[c for c in PAIR if c in raw.columns])
    bad = F.col("_speed").isNull() | (F.col("_speed") <= 0)
    finding = F.struct(
        F.lit("error").alias("severity"), F.lit("C5").alias("rule"), F.lit("edges").alias("entity"),
        F.col("edge_id").cast("long").alias("key"),
        F.concat(F.lit("Edge "), F.col("from").cast("string"), F.lit(" - "),
                 F.col("to").cast("string"),
                 F.lit(": speed is not finite and positive.")).alias("message"))
    # no filter: that would be pushed down with the whole formula of the speed written out for each mention of it
    findings = e.select(F.inline(F.when(bad, F.array(finding))))
    return e.drop("_speed"), findings


def build_network_from_raw(raw_nodes: DataFrame, raw_edges: DataFrame,
                           raw_geometry: DataFrame) -> tuple[NetworkTables, DataFrame]:
    """three raw tables -> (network, findings of C5 and D3)."""
    nodes = derive_node_attributes(raw_nodes)
    edges, f_speed = derive_edge_attributes(raw_edges)
    edges, f_geom = attach_geometry(edges, raw_geometry)
    findings = union_findings([f_speed.select(*FINDING_COLUMNS), f_geom.select(*FINDING_COLUMNS)])
    return NetworkTables(nodes, edges), findings


def build_validated_network(raw_nodes: DataFrame, raw_edges: DataFrame, raw_geometry: DataFrame,
                            path: str) -> tuple[NetworkTables, DataFrame]:
    """F6 with B17: the network built from raw tables, written to ``path`` and read back, and all findings about it.

    The findings of the derivation (C5, D3) and of the validation come in one table;
    ``findings_summary`` of it says whether the network can be used. Raw edges and geometry in buckets by pair are
    joined, written and checked there without a shuffle.
    """
    net, built = build_network_from_raw(raw_nodes, raw_edges, raw_geometry)
    spark = net.nodes.sparkSession

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    nodes = store(net.nodes, "nodes")
    if stores_pair(raw_edges, raw_geometry):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        edges = write_dealt(net.edges, f"etl_edges_{uuid.uuid4().hex}", f"{path}/edges", buckets)
    else:
        edges = store(net.edges, "edges")
    built, stored = store(built, "findings"), NetworkTables(nodes, edges)
    return stored, union_findings([built, validate_network(stored)])
