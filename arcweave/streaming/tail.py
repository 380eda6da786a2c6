"""The newest lines of every run, kept in Spark's state store.

The stream is grouped by run and handled by ``transformWithState``: each run has its total
number of lines and a ring of at most ``n`` lines under their line number modulo ``n``. A batch reads
the total of the runs it brings lines of and overwrites the ring places of their new lines; it neither
reads nor writes any other run. The state lives in RocksDB under the query's checkpoint, is
committed with the batch and restored after a restart, so a replayed batch starts from the state before it.

Of a run's lines in one batch only the newest ``n`` are held in memory; earlier ones are counted. Lines
without an ``event_id`` come before all others of their batch; lines without a run are one more run.

The retained tail is read straight from the state store (``read_tail``), as of the last committed
batch, beside the running query or after it; nothing is written to a table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from arcweave.operators.windows import RETAIN_LINES

FLUSH_INTERVAL = "250 milliseconds"  # fixed value: the reference's flush period
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOTAL, _RING = "total", "ring"
_NONE = -(1 << 63)  # stands for a missing run or event, which the Python side cannot group or order
_UPDATE = "run_id long, total long, offset long, added long"


class TailProcessor(StatefulProcessor):
    """State of one run: ``total`` lines so far, and the newest ``n`` as a ring. ``order`` are the columns that
    order the lines of a batch."""

    def __init__(self, n: int, order: tuple[str, ...]):
        self.n, self.order = n, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState(_TOTAL, "total long")
        self.ring = handle.getMapState(_RING, "place long", "line_no long, event_id long, line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added, newest = 0, []  # a heap: the earliest of the newest n on top
        for chunk in rows:
            places = zip(*[chunk[c].tolist() for c in self.order])
            for place, event, line in zip(places, chunk["event_id"].tolist(), chunk["line"].tolist()):
                item = (place, added, event, line)
                added += 1
                if len(newest) < self.n:
                    heapq.heappush(newest, item)
                else:
                    heapq.heappushpop(newest, item)
        before = self.total.get()[0] if self.total.exists() else 0
        total = before + added
        for line_no, (_, _, event, line) in enumerate(sorted(newest), start=total - len(newest) + 1):
            self.ring.updateValue((line_no % self.n,), (line_no, event, line))
        self.total.update((total,))
        yield pd.DataFrame({"run_id": [key[0]], "total": [total], "offset": [max(total - self.n, 0)],
                            "added": [added]})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; a query copies the session's settings when it starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _back(name: str, column: str | None = None) -> Column:
    return F.nullif(F.col(column or name), F.lit(_NONE)).alias(name)


def tail_updates(log_stream: DataFrame, n: int = RETAIN_LINES, order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """One row for each run that a batch brings lines of: total, offset (lines dropped so far), lines added.

    Lines of a run are numbered in the order of the columns ``order`` within a batch, after those of earlier
    batches. Text logs have no ``event_id`` and are ordered by their places in files
    (``arcweave.sources.files.ARRIVAL``), which are never null.
    """
    if n < 1:
        raise ValueError("at least one line must be kept")
    events = F.col("event_id") if "event_id" in log_stream.columns else F.lit(None).cast("long")
    places = [c for c in order if c != "event_id"]
    return (log_stream.select(F.coalesce("run_id", F.lit(_NONE)).alias("run_id"),
                              F.coalesce(events, F.lit(_NONE)).alias("event_id"), *places, "line").groupBy("run_id")
            .transformWithStateInPandas(TailProcessor(n, order), outputStructType=_UPDATE, outputMode="Update",
                                        timeMode="None")
            .select(_back("run_id"), "total", "offset", "added"))


def stream_tail(log_stream: DataFrame, checkpoint: str, n: int = RETAIN_LINES, on_update=None,
                available_now: bool = False, interval: str = FLUSH_INTERVAL,
                order: tuple[str, ...] = ("event_id",)) -> StreamingQuery:
    """Keep the newest ``n`` lines of every run of a log stream; ``on_update(df, batch_id)`` gets the updates.

    ``n`` must stay the same for one checkpoint.
    """
    with rocksdb_state(log_stream.sparkSession):
        w = tail_updates(log_stream, n, order).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        w = w.format("noop") if on_update is None else w.foreachBatch(on_update)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
        return w.start()


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    with rocksdb_state(spark):
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def run_totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """run_id, total: lines of each run so far."""
    return _state(spark, checkpoint, _TOTAL).select(_back("run_id", "key.run_id"), F.col("value.total").alias("total"))


def read_tail(spark: SparkSession, checkpoint: str, n: int = RETAIN_LINES) -> DataFrame:
    """run_id, event_id, line, line_no, offset of the retained lines, as of the last committed batch."""
    lines = _state(spark, checkpoint, _RING).select(_back("run_id", "key.run_id"), "user_map_value.*")
    totals = run_totals(spark, checkpoint).withColumnRenamed("run_id", "run")
    return (lines.join(totals, F.col("run_id").eqNullSafe(F.col("run")))
            .select("run_id", _back("event_id"), "line", "line_no",
                    F.greatest(F.col("total") - n, F.lit(0)).alias("offset")))
