"""Numbered run logs stored so that a cursor read opens only the files behind the cursor.

Lines are range partitioned and sorted by (run, line number), so a file holds whole stretches of lines of neighbouring runs,
and its row groups carry their smallest and largest line. An index beside the files has one row for each file and run in
it: at most as many rows as there are runs and files together. Retention (H3) and cursors (H4)
are answered from the index first: it knows the number of lines of a run and
which files hold lines after the cursor; only these files are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.operators.windows import RETAIN_LINES

_INDEX = "run_id long, file string, first long, last long, n long"


def write_log(log: DataFrame, path: str, files: int | None = None) -> None:
    """Store ``log`` (run_id, line_no and further columns), clustered by run and line.

    ``files`` is the number of range partitions, the shuffle partitions by default.
    """
    spark = log.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (log.repartitionByRange(n, "run_id", "line_no").sortWithinPartitions("run_id", "line_no")
     .write.mode("overwrite").parquet(f"{path}/lines"))
    stored = spark.read.schema(log.schema).parquet(f"{path}/lines")
    (stored.select("run_id", "line_no", F.col("_metadata.file_name").alias("file"))
     .groupBy("run_id", "file").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"),
                                    F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").parquet(f"{path}/index"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def _open(spark: SparkSession, path: str, needed: DataFrame) -> DataFrame:
    """The files of ``needed`` (at most all files of the store, whose names any scan plans with)."""
    schema = spark.read.parquet(f"{path}/lines").schema
    files = sorted(r[0] for r in needed.select("file").distinct().collect())
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/lines/{f}" for f in files])


def read_since(spark: SparkSession, path: str, after: int | DataFrame = 0, n: int = RETAIN_LINES,
               run_id: int | None = None) -> DataFrame:
    """H3 and H4: the retained lines (the newest ``n`` of a run) with a number above the cursor, and ``offset``.

    ``after`` is a number or a frame ``(run_id, after)``; runs without a cursor are read from the beginning.
    With ``run_id`` one run is read, and its lines are sought by the minima and maxima of row groups too.
    """
    index = read_index(spark, path)
    if run_id is not None:
        index = index.filter(F.col("run_id") == run_id)
    runs = index.groupBy("run_id").agg(F.max("last").alias("total"))
    if isinstance(after, DataFrame):
        runs = runs.join(after.groupBy("run_id").agg(F.max("after").alias("after")), "run_id", "left")
    else:
        runs = runs.withColumn("after", F.lit(int(after)))
    runs = runs.select("run_id", F.greatest(F.col("total") - n, F.lit(0)).alias("offset"),
                       F.coalesce(F.col("after"), F.lit(0)).alias("after"))
    runs = runs.withColumn("behind", F.greatest("offset", "after"))
    needed = index.join(runs, "run_id").filter(F.col("last") > F.col("behind"))
    lines = _open(spark, path, needed)
    if run_id is not None:
        behind = runs.agg(F.max("behind")).first()[0] or 0
        lines = lines.filter((F.col("run_id") == run_id) & (F.col("line_no") > behind))
    return (lines.join(runs, "run_id").filter(F.col("line_no") > F.col("behind"))
            .select(*lines.columns, "offset"))


def run_totals(spark: SparkSession, path: str) -> DataFrame:
    """run_id, total: lines of each run, from the index alone."""
    return read_index(spark, path).groupBy("run_id").agg(F.max("last").alias("total"))
