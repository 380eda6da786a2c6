"""Solver-log analytics, batch and Structured Streaming.

A log line is ``(run_id, event_id, line)``; ``event_id`` is the writer's arrival
sequence. The batch operators live in ``arcweave.operators.windows``; this
module adds run status and the streaming jobs.

Streaming state is bounded: I1 keeps one row per run in the state store and in its table, I3
(``arcweave.streaming.tail``) at most ``n`` lines and one counter per run in the state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcweave.functions import parse_progress
from arcweave.functions.text import ABORT_PATTERN, FAILED_PATTERN, FINISHED_PATTERN
from arcweave.operators.windows import number_within
from arcweave.streaming.latest import BUCKETS, merge_latest

FLUSH_INTERVAL = "250 milliseconds"  # fixed value: the reference's flush period


def number_lines(log: DataFrame) -> DataFrame:
    """H2: absolute 1-based line number per run in arrival order (distributed)."""
    return number_within(log, ["run_id"], ["event_id"], out="line_no")


def run_status(log: DataFrame) -> DataFrame:
    """Status per run from its last closing line: finished, failed or aborted;
    runs without one are running.

    An aborted solve ends through the failure path, so a failure counts as aborted when the
    abort request came after the last line that finished or failed before it.
    """
    line, at = F.col("line"), F.col("event_id")
    kind = (F.when(line.rlike(FAILED_PATTERN), F.lit("failed"))
            .when(line.rlike(ABORT_PATTERN), F.lit("aborted"))
            .when(line.rlike(FINISHED_PATTERN), F.lit("finished")))
    marks = log.select("run_id", "event_id", kind.alias("kind"))
    ends = marks.groupBy("run_id").agg(
        F.max(F.when(F.col("kind") == "aborted", at)).alias("abort_at"),
        F.max(F.when(F.col("kind").isin("failed", "finished"), at)).alias("end_at"),
        F.max_by("kind", F.when(F.col("kind").isin("failed", "finished"), at)).alias("end"),
        F.max(F.when(F.col("kind").isNotNull(), at)).alias("closed_at"))
    # the end before the last one: its solve's abort requests do not count for the last
    earlier = (marks.filter(F.col("kind").isin("failed", "finished"))
               .join(ends.select("run_id", "end_at"), "run_id").filter(at < F.col("end_at"))
               .groupBy("run_id").agg(F.max("event_id").alias("previous_at")))
    requests = (marks.filter(F.col("kind") == "aborted")
                .join(ends.select("run_id", "end_at"), "run_id")
                .join(earlier, "run_id", "left")
                .filter((at < F.col("end_at")) & (at > F.coalesce("previous_at", F.lit(-(1 << 62)))))
                .groupBy("run_id").agg(F.count(F.lit(1)).alias("n")))
    open_abort = F.col("abort_at") > F.coalesce("end_at", F.lit(-(1 << 62)))
    status = (F.when(open_abort, F.lit("aborted"))
              .when((F.col("end") == "failed") & F.col("n").isNotNull(), F.lit("aborted"))
              .otherwise(F.coalesce("end", F.lit("running"))))
    return ends.join(requests, "run_id", "left").select("run_id", status.alias("status"), "closed_at")


# ---------------------------------------------------------------- I1


def progress_updates(log_stream: DataFrame) -> DataFrame:
    """I1 (logic): latest (iteration, distance) per run — one state row per run."""
    p = log_stream.select("run_id", "event_id", parse_progress("line").alias("p")).filter(
        F.col("p.iteration").isNotNull())
    return (p.groupBy("run_id")
            .agg(F.max_by("p", "event_id").alias("last"), F.max("event_id").alias("at"))
            .select("run_id", F.col("last.iteration").alias("iteration"),
                    F.col("last.distance").alias("distance"), "at"))


def stream_progress(log_stream: DataFrame, checkpoint: str,
                    on_progress: Callable[[DataFrame, int], None] | None = None,
                    sink_path: str | None = None, interval: str | None = FLUSH_INTERVAL,
                    available_now: bool = False, buckets: int = BUCKETS) -> StreamingQuery:
    """Live progress on an unbounded log, ``update`` mode, throttled micro-batches.

    Each micro-batch's changed rows go to ``on_progress(df, batch_id)`` (the run callback) and/or are
    merged into the table at ``sink_path`` (``arcweave.streaming.latest``): only the buckets of the changed
    runs are rewritten.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        if on_progress is not None:
            on_progress(batch, batch_id)
        if sink_path is not None:
            merge_latest(batch, sink_path, f"{checkpoint}#{batch_id}", key="run_id", at="at", buckets=buckets)

    w = (progress_updates(log_stream).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint).foreachBatch(handle))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
