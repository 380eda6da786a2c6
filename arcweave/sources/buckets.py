"""Edges and allocations stored bucketed and sorted by the canonical pair.

A bucketed table keeps the shuffle of one write for all later reads: grouping by the pair and joining on
it need no exchange. Tables are external, in a folder of their own; the catalogue holds the bucket
layout. Every task writes one bucket, since rows are dealt with the hash that buckets use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.operators.arcs import PAIR, pair_columns, pair_hi, pair_lo

COMPRESSION = "zstd"  # ids and numbers of a pair's rows take about two thirds of the bytes of Spark's default


def deal_by_pair(df: DataFrame, buckets: int, a: str = "src", b: str = "dst") -> DataFrame:
    """``df`` with its pair as last columns, each bucket in a partition of its own; a pair not stored is not shuffled."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in PAIR]
    stored = all(c in df.columns for c in PAIR)
    dealt = df.repartition(buckets, *(PAIR if stored else (pair_lo(a, b), pair_hi(a, b))))
    return dealt.select(*rest, *pair_columns(df, a, b))


def write_dealt(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store rows that ``deal_by_pair`` dealt, or that were derived from a table stored so, where they are: no shuffle."""
    (df.write.mode("overwrite").bucketBy(buckets, *PAIR).sortBy(*PAIR).option("path", path)
     .option("compression", COMPRESSION).saveAsTable(table))
    return df.sparkSession.table(table)


def write_by_pair(df: DataFrame, table: str, path: str, buckets: int, a: str = "src", b: str = "dst") -> DataFrame:
    """Store ``df`` with its pair as table ``table`` at ``path``; returns the stored table."""
    return write_dealt(deal_by_pair(df, buckets, a, b), table, path, buckets)


def attach_by_pair(spark: SparkSession, table: str, path: str, schema: str, buckets: int) -> DataFrame:
    """Name a folder that ``write_by_pair`` filled in the catalogue of another session."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{table}` ({schema}) USING parquet CLUSTERED BY ({', '.join(PAIR)}) "
              f"SORTED BY ({', '.join(PAIR)}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)
