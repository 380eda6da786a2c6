"""File sources and sinks (A1–A3, A5, A10: JSON records and plain text).

CSV is read without schema inference: every column arrives as text and is typed
by the validation step (B2/B3), so a bad value becomes a finding instead of a
silently changed column type. Parquet and catalogue tables keep their types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from arcweave.operators.windows import sequence_number
from arcweave.session import ensure_checkpoint_dir
from arcweave.sources.fixtures import NetworkTables
from arcweave.sources.positions import number_rows, with_places

RUN_LOG_SCHEMA = "run_id long, event_id long, line string"


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
                .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))
    if fmt == "table":
        return spark.read.table(path)
    return spark.read.format(fmt).load(path)


def read_nodes(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1: node table; CSV columns are text until typed."""
    return _read(spark, path, fmt)


def read_edges(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A2: edge table; the WKT field is quoted, quotes inside are doubled.

    Without an ``edge_id`` column, rows are numbered from 1 in the order of their files and places in them, so that
    findings name the same rows however the files are split (``arcweave.sources.positions``); the
    rows are stored once for that. Rows of a view, which have no place in a file, are numbered in ``(from, to)`` order.
    """
    df = _read(spark, path, fmt)
    if "edge_id" in df.columns:
        return df
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return sequence_number(df, ["from", "to"], "edge_id").select("*")
    ensure_checkpoint_dir(spark)
    return number_rows(df, "edge_id")


def load_network(spark: SparkSession, directory: str, fmt: str = "csv",
                 nodes_name: str = "nodes", edges_name: str = "edges") -> NetworkTables:
    """A3: a named dataset folder with a nodes and an edges table.

    A missing table raises ``FileNotFoundError`` naming it (checked at analysis
    time, before any job runs).
    """
    ext = "" if fmt == "table" else f".{fmt}"
    base = directory.rstrip("/")
    out = {}
    for name, reader in ((nodes_name, read_nodes), (edges_name, read_edges)):
        path = f"{base}/{name}{ext}"
        try:
            out[name] = reader(spark, path, fmt)
        except AnalysisException as e:
            raise FileNotFoundError(f"dataset {directory!r} has no {name} table ({path})") from e
    return NetworkTables(out[nodes_name], out[edges_name])


def write_results(node_df: DataFrame | None, edge_df: DataFrame | None, path: str,
                  fmt: str = "csv", compression: str = "gzip") -> None:
    """A5: node and edge result tables, CSV with header (or Parquet), overwrite.

    Written in parallel as part files; sorting by id happens only here, at the sink. CSV is compressed, which
    ``spark.read.csv`` and other readers of CSV undo; ``none`` writes plain files.
    """
    base = path.rstrip("/")
    for name, df, key in (("nodes_results", node_df, ["node"]),
                          ("edges_results", edge_df, ["from", "to"])):
        if df is None:
            continue
        w = df.sortWithinPartitions(*key).write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).option("compression", compression).csv(f"{base}/{name}")
        else:
            w.format(fmt).save(f"{base}/{name}")


def write_lines(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Newline-delimited text sink (used by the GeoJSON feature rows), compressed: each row repeats all property names.

    ``spark.read.text`` and other readers of text files undo it; ``none`` writes plain files.
    """
    df.select(F.col("feature").alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def read_run_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """A10: solver-log lines as ``(run_id, event_id, line)`` JSON records, batch or stream.

    ``event_id`` is the writer's arrival sequence; the line number per run is
    derived from it (H2).
    """
    reader = spark.readStream if streaming else spark.read
    return reader.schema(RUN_LOG_SCHEMA).json(path)


RUN_PREFIX = r"^\[run (\d+)\] ?"
ARRIVAL = ("file", "block", "row")  # order of arrival of text lines


def _text_lines(reader, path: str) -> DataFrame:
    df = reader.text(path)
    if "run_id" in df.columns:
        return df.select(F.col("run_id").cast("long").alias("run_id"), F.col("value").alias("line"), "_metadata")
    return df.select(F.regexp_extract("value", RUN_PREFIX, 1).try_cast("long").alias("run_id"),
                     F.regexp_replace("value", RUN_PREFIX, "").alias("line"), "_metadata")


def read_text_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """A10: plain text logs, batch or stream: one line of output a row.

    The run is the folder ``run_id=<n>`` of a file, or else the prefix ``[run <n>] `` of a line (a line without one has a null
    run). Lines of one file arrive in file order, files in the order of their paths.
    Batch: ``(run_id, event_id, line)``, where ``event_id`` is the number of the line in arrival order, the same for
    any split size. Stream: ``(run_id, file, block, row, line)``; ``ARRIVAL`` orders the lines of a batch.
    """
    if streaming:
        return with_places(_text_lines(spark.readStream, path)).select("run_id", *ARRIVAL, "line")
    ensure_checkpoint_dir(spark)
    numbered = number_rows(_text_lines(spark.read, path), "event_id")
    return numbered.select("run_id", "event_id", "line")
