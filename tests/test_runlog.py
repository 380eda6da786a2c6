"""Log numbering, windows and streams: stream result = batch result."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from arcweave.operators import windows as W
from arcweave.sources import files as IO
from arcweave.streaming import latest as L
from arcweave.streaming import runlog as R

LINES = [(r, e, f"Iteration No. {k} distance={10.0 / k} duration=0.1 secs. Welfare=1")
         for r in (1, 2) for k, e in enumerate(range(r * 100, r * 100 + 12), start=1)]
LINES += [(1, 500, "[app] Solve finished in 3.0 s."), (2, 600, "[app] Solve FAILED after 1.0 s.")]


def log_df(spark):
    return spark.createDataFrame(LINES, "run_id long, event_id long, line string")


def test_number_lines_matches_sort(spark):
    got = W.number_within(log_df(spark), ["run_id"], ["event_id"]).collect()
    for run in (1, 2):
        mine = sorted((r["event_id"], r["line_no"]) for r in got if r["run_id"] == run)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_sequence_number_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    seq = sorted((r["k"], r["seq"]) for r in W.sequence_number(df, ["k"]).collect())
    assert [s for _, s in seq] == list(range(1, 1001))


def test_retain_and_cursor(spark):
    log = R.number_lines(log_df(spark))
    kept = W.retain_last(log, 5)
    assert kept.filter(F.col("run_id") == 1).count() == 5
    assert {r["offset"] for r in kept.filter(F.col("run_id") == 1).collect()} == {8}
    since = W.lines_since(kept, 10).filter(F.col("run_id") == 1).collect()
    assert sorted(r["line_no"] for r in since) == [11, 12, 13]


def test_status_and_progress(spark):
    st = {r["run_id"]: r["status"] for r in R.run_status(log_df(spark)).collect()}
    assert st == {1: "finished", 2: "failed"}
    p = {r["run_id"]: r["iteration"] for r in
         W.latest_progress(R.number_lines(log_df(spark))).collect()}
    assert p == {1: 12, 2: 12}


def _write(folder, rows, name):
    with open(os.path.join(folder, name), "w") as fh:
        for r, e, line in rows:
            fh.write(json.dumps({"run_id": r, "event_id": e, "line": line}) + "\n")


def test_stream_progress_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="arcweave-i1-", dir="/tmp")
    src = os.path.join(base, "src")
    os.makedirs(src)
    half = len(LINES) // 2
    for i, chunk in enumerate((LINES[:half], LINES[half:])):
        _write(src, chunk, f"part-{i}.json")
        q = R.stream_progress(IO.read_run_log(spark, src, streaming=True),
                              os.path.join(base, "ck"), sink_path=os.path.join(base, "sink"),
                              available_now=True)
        q.awaitTermination()
    got = sorted((r["run_id"], r["iteration"], r["distance"])
                 for r in L.read_latest(spark, os.path.join(base, "sink")).collect())
    want = sorted((r["run_id"], r["iteration"], r["distance"])
                  for r in R.progress_updates(log_df(spark)).collect())
    assert got == want


def test_stream_progress_live_trigger(spark):
    """The throttled trigger (250 ms) keeps the live table current while files arrive."""
    base = tempfile.mkdtemp(prefix="arcweave-live-", dir="/tmp")
    src = os.path.join(base, "src")
    os.makedirs(src)
    _write(src, LINES[:10], "part-0.json")
    seen = []
    q = R.stream_progress(IO.read_run_log(spark, src, streaming=True), os.path.join(base, "ck"),
                          on_progress=lambda df, bid: seen.append(bid),
                          sink_path=os.path.join(base, "sink"))
    try:
        q.processAllAvailable()
        _write(src, LINES[10:], "part-1.json")
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["run_id"], r["iteration"])
                 for r in L.read_latest(spark, os.path.join(base, "sink")).collect())
    assert got == [(1, 12), (2, 12)] and len(seen) >= 2
