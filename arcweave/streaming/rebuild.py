"""I4: publish a new version of the results when a complete set of edge files has arrived.

An upload is a folder ``upload=<name>`` of edge files; a manifest row ``(upload, n_files, n_rows)`` says what belongs
to it. Files and manifests arrive in any order and in any number of batches. A batch enters its files
with their row counts, and its manifests, in a ledger (one small folder a batch, overwritten by a
replayed batch). An upload is complete when the ledger has as many files and rows as announced;
then its files are read where they are and published as the next version. An incomplete one waits and publishes
nothing, whatever else arrives; so does one with more rows than announced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from arcweave.plans import incremental

FLUSH_INTERVAL = "250 milliseconds"  # fixed value: the reference's flush period
MANIFEST = "upload string, n_files long, n_rows long"
_LEDGER = "upload string, file string, rows long, n_files long, n_rows long"


def _arrivals(spark: SparkSession, edges_path: str, schema: StructType, manifests_path: str) -> DataFrame:
    files = (spark.readStream.schema(StructType([*schema.fields, StructField("upload", StringType())])).option("basePath", edges_path)
             .parquet(f"{edges_path}/upload=*").select("upload", F.col("_metadata.file_path").alias("file"),
                                                       F.lit(None).cast("long").alias("n_files"),
                                                       F.lit(None).cast("long").alias("n_rows")))
    announced = spark.readStream.schema(MANIFEST).json(manifests_path).select(
        "upload", F.lit(None).cast("string").alias("file"), "n_files", "n_rows")
    return files.unionByName(announced)


def complete_uploads(ledger: DataFrame) -> DataFrame:
    """upload, files (array): uploads with the announced number of files and rows."""
    by_upload = ledger.groupBy("upload").agg(
        F.max("n_files").alias("n_files"), F.max("n_rows").alias("n_rows"),
        F.count("file").alias("files_here"), F.sum("rows").alias("rows_here"),
        F.array_sort(F.collect_list("file")).alias("files"))
    return by_upload.filter((F.col("n_files") == F.col("files_here"))
                            & (F.col("n_rows") == F.coalesce("rows_here", F.lit(0)))).select("upload", "files")


def stream_rebuild(spark: SparkSession, edges_path: str, schema: StructType, manifests_path: str, sink: str,
                   checkpoint: str, publish: Callable[[DataFrame, str, int], None], available_now: bool = False,
                   interval: str = FLUSH_INTERVAL) -> StreamingQuery:
    """Call ``publish(edges, upload, version)`` for every upload that becomes complete, in the order of their names.

    ``publish`` must enter the upload among the versions under ``sink`` (``arcweave.plans.incremental``) as its last
    step, and give the same result when it is called again.
    """
    ledger = f"{sink}/ledger"

    def handle(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy("upload", "file").agg(F.count("file").alias("rows"), F.max("n_files").alias("n_files"),
                                             F.max("n_rows").alias("n_rows"))
         .write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}"))
        known = spark.read.schema(_LEDGER).parquet(ledger).select("upload", "file", "rows", "n_files", "n_rows")
        done = incremental.versions(spark, sink)
        ready = complete_uploads(known)
        if done is not None:
            ready = ready.join(done.select("upload").distinct(), "upload", "left_anti")
        # file names of uploads that became complete with this batch
        for upload, files in sorted(map(tuple, ready.collect())):
            edges = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
            publish(edges, upload, incremental.newest(spark, sink) + 1)

    w = (_arrivals(spark, edges_path, schema, manifests_path).writeStream
         .option("checkpointLocation", checkpoint).foreachBatch(handle))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def f1_publisher(arc_infra: DataFrame, arc_flow: DataFrame | None, sink: str, n_goods: int = 1,
                 buckets: int = incremental.BUCKETS) -> Callable[[DataFrame, str, int], None]:
    """Publishes F1 of the uploaded edges, recomputing changed pairs only."""
    def publish(edges: DataFrame, upload: str, version: int) -> None:
        incremental.publish_edges(edges, arc_infra, arc_flow, sink, version, n_goods, upload, buckets)

    return publish
