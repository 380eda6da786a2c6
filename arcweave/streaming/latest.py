"""A table of the latest row per key, kept up to date by the batches of a stream.

Keys are dealt over ``buckets`` folders by their hash. A batch reads and rewrites only the buckets of its
own keys, by dynamic partition overwrite, which also removes the files that it supersedes: the table
has at most one file a bucket however many batches there were.

Replacing a bucket is not atomic, so a batch is first merged into a staging folder and
marked as staged. A batch that is replayed after a crash and finds its mark copies the staged buckets again and
reads none of the (perhaps half replaced) buckets of the table; without the mark no bucket has
been touched yet. A reader that meets a bucket while it is replaced fails on a missing file and reads again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table, or nothing where there is no folder yet; any other error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def merge_latest(batch: DataFrame, path: str, mark: str, key: str, at: str, buckets: int = BUCKETS) -> None:
    """Bring the rows of ``batch`` into the table; of equal keys the row with the largest ``at`` stays.

    ``mark`` names the batch, the same when it is replayed.
    """
    spark = batch.sparkSession
    bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    staged, marks = f"{path}/_staged", f"{path}/_mark"
    marked = _read(spark, marks, StructType().add("mark", "string"))
    if marked is None or [r[0] for r in marked.collect()] != [mark]:  # one row
        bucketed = bucketed.persist()
        try:
            # at most ``buckets`` numbers
            touched = [r[0] for r in bucketed.select("bucket").distinct().collect()]
            if not touched:
                return
            old = _read(spark, path, bucketed.schema)
            rows = bucketed if old is None else old.filter(F.col("bucket").isin(touched)).unionByName(bucketed)
            rest = [c for c in bucketed.columns if c not in (key, "bucket")]
            (rows.groupBy("bucket", key).agg(F.max_by(F.struct(*rest), at).alias("row"))
             .select(key, "row.*", "bucket").repartition(len(touched), "bucket")
             .write.mode("overwrite").partitionBy("bucket").parquet(staged))
        finally:
            bucketed.unpersist()
        spark.range(1).select(F.lit(mark).alias("mark")).coalesce(1).write.mode("overwrite").parquet(marks)
    (spark.read.schema(bucketed.schema).parquet(staged).repartition("bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of every key."""
    return spark.read.parquet(path).drop("bucket")
