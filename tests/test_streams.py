"""Keyed stream state: retained tails in the state store, the bucketed table of latest rows."""

import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from arcweave.operators import windows as W
from arcweave.streaming import latest as L
from arcweave.streaming import runlog as R
from arcweave.streaming import tail as T

LOG = "run_id long, event_id long, line string"


def folder(name):
    return tempfile.mkdtemp(prefix=f"arcweave-{name}-", dir="/tmp")


def run_tail(spark, src, ck, n, seen):
    stream = spark.readStream.schema(LOG).json(src)
    T.stream_tail(stream, ck, n, available_now=True,
                  on_update=lambda df, b: seen.append((b, sorted((tuple(r) for r in df.collect()), key=repr)))).awaitTermination()


def test_tail_over_batches_and_restarts(spark):
    base, n = folder("tail"), 6
    src, ck, seen = f"{base}/src", f"{base}/ck", []
    rng = random.Random(1)
    log, event = [], 0
    for batch, runs in enumerate(([1, 2, 3], [2], [3, 4], [1, 4])):
        rows = []
        for _ in range(40):
            event += 1
            rows.append((rng.choice(runs), event, f"line {event}"))
        log += rows
        rng.shuffle(rows)  # arrival within a batch is by event, not by place in the files
        spark.createDataFrame(rows, LOG).repartition(3).write.mode("append").json(src)
        run_tail(spark, src, ck, n, seen)  # every batch is a restart from the checkpoint
        want = W.retain_last(R.number_lines(spark.createDataFrame(log, LOG)), n).select(
            "run_id", "event_id", "line", "line_no", "offset")
        got = T.read_tail(spark, ck, n)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        # only the runs of the batch were handled
        changed = [u for b, u in seen if u][-1]
        assert {u[0] for u in changed} == set(runs) and sum(u[3] for u in changed) == 40
    held = T._state(spark, ck, "ring").groupBy("key.run_id").count().collect()
    assert max(r["count"] for r in held) <= n
    assert {r.run_id: r.total for r in T.run_totals(spark, ck).collect()} == {
        r: sum(x[0] == r for x in log) for r in (1, 2, 3, 4)}


def test_tail_of_awkward_rows(spark):
    base = folder("tail-odd")
    rows = [(None, 1, "a"), (None, None, "first"), (7, 2, None), (7, 2, ""), (7, 3, "é\t")]
    spark.createDataFrame(rows, LOG).coalesce(1).write.json(f"{base}/src", ignoreNullFields=False)
    run_tail(spark, f"{base}/src", f"{base}/ck", 2, [])
    got = {(r.run_id, r.line_no): (r.event_id, r.line, r.offset) for r in T.read_tail(spark, f"{base}/ck", 2).collect()}
    assert got[(None, 1)] == (None, "first", 0) and got[(None, 2)] == (1, "a", 0)
    assert got[(7, 3)] == (3, "é\t", 1) and len(got) == 4
    with pytest.raises(ValueError):
        T.tail_updates(spark.readStream.schema(LOG).json(f"{base}/src"), 0)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def merge(spark, path, batch, rows, buckets=4):
    df = spark.createDataFrame(rows, "run_id long, iteration long, at long").coalesce(1)
    L.merge_latest(df, path, f"ck#{batch}", "run_id", "at", buckets)


def test_files_stay_bounded_over_100_batches(spark):
    path, want, rng = folder("latest") + "/t", {}, random.Random(2)
    for batch in range(100):
        rows = [(rng.randrange(40), batch, batch) for _ in range(2)][:1 + batch % 2]
        rows = list({r[0]: r for r in rows}.values())
        before = files(path)
        merge(spark, path, batch, rows)
        want.update({r: (i, at) for r, i, at in rows})
        after = files(path)
        assert len(after) <= 4
        # buckets without a run of the batch keep their files
        kept = {f for f in before if before[f] == after.get(f)}
        assert len(kept) >= len(before) - len(rows)
    assert {r.run_id: (r.iteration, r["at"]) for r in L.read_latest(spark, path).collect()} == want


def test_a_replayed_batch_heals_a_half_replaced_table(spark):
    path = folder("replay") + "/t"
    merge(spark, path, 0, [(i, 0, 0) for i in range(50)])
    merge(spark, path, 1, [(i, 1, 1) for i in range(0, 50, 7)])
    want = sorted(map(tuple, L.read_latest(spark, path).collect()))
    victim = sorted(files(path))[0]
    os.remove(victim)  # a bucket was deleted and its new file not yet moved in
    merge(spark, path, 1, [(i, 1, 1) for i in range(0, 50, 7)])
    assert sorted(map(tuple, L.read_latest(spark, path).collect())) == want
    merge(spark, path, 2, [(3, 9, -1)])  # an older row does not win
    assert L.read_latest(spark, path).filter(F.col("run_id") == 3).first().iteration == 0
    merge(spark, path, 3, [])
    assert L.read_latest(spark, path).count() == 50
