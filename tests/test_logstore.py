"""Cursor reads of a stored log open only the files behind the cursor."""

import os
import random
import tempfile

import pytest

from arcweave.operators import windows as W
from arcweave.sources import logstore as LS
from arcweave.streaming import runlog as R


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(1)
    # run 5 holds most lines and spans several files
    rows = [(5 if rng.random() < 0.7 else rng.randrange(1, 9), e, f"line {e}") for e in range(3000)]
    log = R.number_lines(spark.createDataFrame(rows, "run_id long, event_id long, line string")).cache()
    path = tempfile.mkdtemp(prefix="arcweave-logs-", dir="/tmp") + "/t"
    LS.write_log(log, path, 10)
    return log, path


def names(df):
    return {os.path.basename(f) for f in df.inputFiles() if "/lines/" in f}


def rows(df):
    return sorted(map(tuple, df.select("run_id", "event_id", "line", "line_no", "offset").collect()))


@pytest.mark.parametrize("n", [50, 5000])
def test_reads_equal_the_plain_operators(spark, stored, n):
    log, path = stored
    kept = W.retain_last(log, n)
    assert rows(LS.read_since(spark, path, 0, n)) == rows(kept)
    assert rows(LS.read_since(spark, path, 700, n)) == rows(W.lines_since(kept, 700))
    cursors = spark.createDataFrame([(5, 1900), (1, 0), (2, 10**6), (99, 3)], "run_id long, after long")
    assert rows(LS.read_since(spark, path, cursors, n)) == rows(W.lines_since(kept, cursors))
    assert rows(LS.read_since(spark, path, 1950, n, run_id=5)) == rows(W.lines_since(kept, 1950).filter("run_id = 5"))
    assert LS.read_since(spark, path, 0, n, run_id=77).count() == 0


def test_only_files_behind_the_cursor_are_opened(spark, stored):
    log, path = stored
    total = log.filter("run_id = 5").count()
    index = LS.read_index(spark, path).collect()
    every = {r.file for r in index}
    assert len(every) == 10 and len({r.file for r in index if r.run_id == 5}) >= 6
    for after in (0, total // 2, total - 5):
        df = LS.read_since(spark, path, after, 10**6, run_id=5)
        assert names(df) == {r.file for r in index if r.run_id == 5 and r.last > after}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThan(line_no,{total - 5})" in plan and "EqualTo(run_id,5)" in plan
    # a cursor at the end of every run opens nothing
    ends = LS.run_totals(spark, path).withColumnRenamed("total", "after")
    assert names(LS.read_since(spark, path, ends, 10**6)) == set()
    assert {r.run_id: r.total for r in LS.run_totals(spark, path).collect()} == {
        r.run_id: r["max(line_no)"] for r in log.groupBy("run_id").max("line_no").collect()}
