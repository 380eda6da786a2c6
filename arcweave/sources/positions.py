"""Stable row numbers of files: the place of a row in its file, whatever the split size.

A scan reads a file in blocks, the rows of a block in file order and in one task. The scanned rows are written once
with their file, the block's start and a number that grows inside a task; then one row for each block says how many
rows come before it, and a row's number is that plus its place in the block. Files count in the order of
their paths. The numbers do not depend on how files were cut into blocks or blocks dealt over tasks, and a
lost task cannot change them, since the rows are stored before they are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from arcweave.session import scratch_dir

BROADCAST_BLOCKS = 100_000  # one row for each block of a file; more are joined without a hint


def place_columns() -> list:
    """File, block and a number that grows inside the block, as columns of a file scan."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")]


def with_places(stream: DataFrame) -> DataFrame:
    """The same columns, ``file``, ``block`` and ``row``, for a stream of files.

    Streams have no row numbers of their own, so the rows of a task are counted as they pass.
    """
    columns = [F.col(f"`{c}`") for c in stream.columns if c != "_metadata"]
    placed = stream.select(*columns, F.col("_metadata.file_path").alias("file"),
                           F.col("_metadata.file_block_start").alias("block"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            row = pa.array(range(seen, seen + batch.num_rows), pa.int64())
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, row], names=[*batch.schema.names, "row"])

    return placed.mapInArrow(count, StructType([*placed.schema.fields, StructField("row", LongType())]))


def number_rows(scan: DataFrame, out: str = "row_no", per_file: bool = False) -> DataFrame:
    """The columns of a file scan and ``out``: the 1-based number of the row in all files, or in its file."""
    columns = [F.col(f"`{c}`") for c in scan.columns if c != "_metadata"]
    stored = f"{scratch_dir(scan.sparkSession, 'scanned')}"
    placed = scan.select(F.struct(*columns).alias("data"), *place_columns())
    placed.write.parquet(stored)
    rows = scan.sparkSession.read.schema(placed.schema).parquet(stored)
    blocks = rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).checkpoint()
    order = Window.partitionBy("file").orderBy("block") if per_file else Window.orderBy("file", "block")
    before = blocks.select("file", "block", "first", (F.sum("n").over(order) - F.col("n")).alias("before"))
    if blocks.count() <= BROADCAST_BLOCKS:
        before = F.broadcast(before)
    return rows.join(before, ["file", "block"]).select(
        "data.*", (F.col("before") + F.col("row") - F.col("first") + 1).alias(out))
