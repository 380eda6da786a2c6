"""Ordered numbering and log-window operators (H2–H6).

``row_number()`` over a window puts a whole partition-by group in one task.
A run log, or an edge list numbered globally, can have one group holding a
large share of all rows, so numbering here is distributed instead: the rows
are range-partitioned on the order key (Spark samples the bounds), numbered
inside each partition, and shifted by the row counts of the earlier
partitions — a table with one row per partition, so its broadcast is
size-proven.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.functions import parse_progress
from arcweave.session import ensure_checkpoint_dir

_POS_MASK = (1 << 33) - 1


def sequence_number(df: DataFrame, order_cols: list[str], out: str = "seq",
                    partitions: int | None = None) -> DataFrame:
    """Global 1-based position of each row in ``order_cols`` order (ties in any order).

    The range-partitioned, sorted rows are checkpointed once, so the partition
    bounds and row positions are fixed even if a task is recomputed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(n, *order_cols)
               .sortWithinPartitions(*order_cols)
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint())
    ordered = (ordered.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
               .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_POS_MASK))))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the running sum is a single small window.
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (ordered.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_pos") + 1)
            .drop("_mid", "_pid", "_pos", "_off"))


def number_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                  out: str = "line_no", partitions: int | None = None) -> DataFrame:
    """H2: 1-based position inside each group, in ``order_cols`` order.

    Global position over ``(group, order)`` minus the group's first position; the
    per-group minimum is a partial aggregate, so a hot group is never gathered.
    """
    seq = sequence_number(df, [*group_cols, *order_cols], "_seq", partitions)
    first = seq.groupBy(*group_cols).agg(F.min("_seq").alias("_first"))
    return (seq.join(first, group_cols)
            .withColumn(out, F.col("_seq") - F.col("_first") + 1)
            .drop("_seq", "_first"))


RETAIN_LINES = 5000  # fixed value: newest lines kept per run


def retain_last(log: DataFrame, n: int = RETAIN_LINES, run_col: str = "run_id") -> DataFrame:
    """H3: newest ``n`` lines per run; adds ``offset`` = lines dropped before the first kept."""
    total = log.groupBy(run_col).agg(F.max("line_no").alias("total"))
    return (log.join(total, run_col)
            .filter(F.col("line_no") > F.col("total") - n)
            .withColumn("offset", F.greatest(F.col("total") - n, F.lit(0)))
            .drop("total"))


def lines_since(retained: DataFrame, after, run_col: str = "run_id") -> DataFrame:
    """H4: lines with index > ``after`` (clipped to the retained range) and the run total.

    ``after`` is a number or a frame ``(run_id, after)`` of per-run cursors.
    """
    total = retained.groupBy(run_col).agg(F.max("line_no").alias("total"))
    df = retained.join(total, run_col)
    if isinstance(after, DataFrame):
        df = df.join(after, run_col, "left").withColumn(
            "after", F.coalesce(F.col("after"), F.lit(0)))
    else:
        df = df.withColumn("after", F.lit(int(after)))
    return (df.filter(F.col("line_no") > F.greatest(F.col("after"), F.col("offset")))
            .drop("after"))


def latest_progress(log: DataFrame, max_iter: float | None = None,
                    run_col: str = "run_id") -> DataFrame:
    """H5: last parsed progress line per run: iteration, distance, share of ``max_iter``."""
    p = log.select(run_col, "line_no", parse_progress("line").alias("p")).filter(
        F.col("p.iteration").isNotNull())
    last = p.groupBy(run_col).agg(F.max_by("p", "line_no").alias("last"))
    out = last.select(run_col, F.col("last.iteration").alias("iteration"),
                      F.col("last.distance").alias("distance"))
    if max_iter is not None:
        out = out.withColumn("share", F.col("iteration") / F.lit(float(round(max_iter))))
    return out


def convergence(log: DataFrame, tol: float, run_col: str = "run_id") -> DataFrame:
    """H6: distance per iteration, its change from the previous progress line, and the
    first iteration under ``tol`` (per run, repeated on each row).

    The previous line is found by numbering the progress lines per run
    (distributed, see ``number_within``) and joining ``k`` to ``k − 1``: the join
    key is unique per row, so no run is ever gathered into one task.
    """
    p = (log.select(run_col, "line_no", parse_progress("line").alias("p"))
         .filter(F.col("p.iteration").isNotNull())
         .select(run_col, "line_no", F.col("p.iteration").alias("iteration"),
                 F.col("p.distance").alias("distance")))
    k = number_within(p, [run_col], ["line_no"], out="_k")
    prev = k.select(run_col, (F.col("_k") + 1).alias("_k"), F.col("distance").alias("_prev"))
    first = p.groupBy(run_col).agg(
        F.min(F.when(F.col("distance") < F.lit(float(tol)), F.col("iteration"))).alias(
            "first_converged"))
    return (k.join(prev, [run_col, "_k"], "left")
            .withColumn("change", F.col("distance") - F.col("_prev"))
            .drop("_k", "_prev")
            .join(first, run_col))
