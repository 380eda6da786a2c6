"""Publishing: GeoJSON feature rows (A6, A7, C13) and scaled metric columns.

Features are one JSON text per row (newline-delimited GeoJSON), so writing
them stays distributed; nothing is assembled into one document on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from arcweave.functions import normalise, round_sig, transform_value
from arcweave.operators.aggregates import scale_domains

JSON_OPTS = {"ignoreNullFields": "false"}
SKIP_PROPS = ("lon", "lat", "line", "geometry")


def feature_properties(df: DataFrame, skip: tuple[str, ...] = SKIP_PROPS) -> Column:
    """Struct of all columns but coordinates; whole numbers (ids, counts) exact, other
    numbers to 7 significant digits (non-finite -> null), other values as text."""
    fields = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, IntegralType):
            fields.append(c.cast("long").alias(f.name))
        elif isinstance(f.dataType, NumericType):
            fields.append(round_sig(c.cast("double"), 7).alias(f.name))
        else:
            fields.append(c.cast("string").alias(f.name))
    return F.struct(*fields)


def _coords(line: Column) -> Column:
    return F.transform(line, lambda p: F.array(round_sig(p["lon"], 7), round_sig(p["lat"], 7)))


def edge_features(edge_df: DataFrame, line_col: str = "line") -> DataFrame:
    """One GeoJSON ``Feature`` (LineString + properties) per edge with a line.

    ``edge_df`` carries the resolved ``line`` (D2) beside the result columns.
    """
    props = feature_properties(edge_df)
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.lit("LineString").alias("type"),
                             _coords(F.col(line_col)).alias("coordinates")).alias("geometry"),
                    props.alias("properties"))
    return edge_df.filter(F.col(line_col).isNotNull()).select(
        "from", "to", F.to_json(feat, JSON_OPTS).alias("feature"))


def node_features(node_df: DataFrame) -> DataFrame:
    """One GeoJSON ``Feature`` (Point + properties) per node."""
    props = feature_properties(node_df)
    coords = F.array(round_sig("lon", 7), round_sig("lat", 7))
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.lit("Point").alias("type"), coords.alias("coordinates")).alias(
                        "geometry"),
                    props.alias("properties"))
    return node_df.select("node", F.to_json(feat, JSON_OPTS).alias("feature"))


def scaled_features(df: DataFrame, metrics: dict[str, str], keys: list[str],
                    percent: tuple[str, ...] = ("perc_upgraded",),
                    diverging: tuple[str, ...] = ()) -> DataFrame:
    """per metric, the transformed value min–max scaled to [0, 1] over its finite
    domain; out-of-domain values are null. All domains come from one aggregate
    pass, attached as a one-row broadcast."""
    dom = F.broadcast(scale_domains(df, metrics, percent, diverging))  # one row
    j = df.crossJoin(dom)
    cols = []
    for key, tf in metrics.items():
        t = transform_value(F.col(key).cast("double"), tf)
        t = F.when(~F.isnan(t) & (F.abs(t) != F.lit(float("inf"))), t)
        cols.append(normalise(t, F.col(f"lo_{key}"), F.col(f"hi_{key}")).alias(f"{key}_scaled"))
    return j.select(*keys, *cols)
