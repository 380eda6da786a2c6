"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.session import ensure_checkpoint_dir, scratch_dir

#: White space between words: space and the control characters tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts the lineage, gives the planner exact sizes for the next joins, and the
    files outlive any executor.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stored``, bucketed by ``key``: joins on it and aggregations by it do not shuffle the rows again.

    A bucket is one file where ``df`` comes from a shuffle by the key into the session's number of partitions.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_dir(spark, name)
    at = path.rsplit("/", 1)[-1].replace("-", "_")
    (df.write.option("compression", "zstd").bucketBy(n_partitions(spark), key).sortBy(key).option("path", path)
     .saveAsTable(at))
    return spark.table(at)


def words(text: Column) -> Column:
    """Array of the words of ``text`` (runs of characters other than ASCII white space).

    Null and blank texts give an empty array.
    """
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{ASCII_SPACE}]+", -1))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until ``df`` has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
