"""Row numbers of files do not depend on how the files are split."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from arcweave.checks.catalog import all_queries
from arcweave.checks.registry import BLOCKS_A_FILE, small_blocks, split_size
from arcweave.session import ensure_checkpoint_dir
from arcweave.sources import files as IO
from arcweave.sources.positions import number_rows
from arcweave.streaming import runlog as R
from arcweave.streaming import tail as T

from conftest import SF_SMALL


def folder(name):
    return tempfile.mkdtemp(prefix=f"arcweave-{name}-", dir="/tmp")


def test_text_lines_for_any_split_size(spark):
    rng, d, want = random.Random(1), folder("text"), []
    for i in range(4):
        with open(f"{d}/{i}.log", "w") as fh:
            for _ in range((300, 0, 7, 400)[i]):
                run, text = rng.randrange(1, 4), "é " * rng.randrange(30)
                line = rng.choice([f"[run {run}] {text}", text, "", f"[run x] {text}", f"[run {run}]"])
                fh.write(line + "\n")
                want.append(line)
    expected = [((int(x[5]), x[8:] if len(x) > 7 else "") if x[:5] == "[run " and x[5].isdigit() else (None, x))
                for x in want]
    for size in (100, 1000, 1 << 27):
        with split_size(spark, size):
            got = sorted((r.event_id, r.run_id, r.line) for r in IO.read_text_log(spark, d).collect())
        assert [g[0] for g in got] == list(range(1, len(want) + 1))
        assert [g[1:] for g in got] == expected


def test_run_folders_and_numbers_per_file(spark):
    d = folder("runs")
    for run in (3, 12):
        os.makedirs(f"{d}/run_id={run}")
        for part in (0, 1):
            with open(f"{d}/run_id={run}/{part}.log", "w") as fh:
                fh.writelines(f"{run}-{part}-{k}\n" for k in range(50))
    with split_size(spark, 64):
        log = R.number_lines(IO.read_text_log(spark, d))
        got = {(r.run_id, r.line_no): r.line for r in log.collect()}
        per_file = number_rows(spark.read.text(d), "n", per_file=True)
        assert {r["n"]: r["count"] for r in per_file.groupBy("n").count().collect()} == {k: 4 for k in range(1, 51)}
    assert got == {(run, part * 50 + k + 1): f"{run}-{part}-{k}" for run in (3, 12) for part in (0, 1) for k in range(50)}
    ck = folder("runs-ck") + "/ck"
    with split_size(spark, 64):
        T.stream_tail(IO.read_text_log(spark, d, streaming=True), ck, n=30, available_now=True,
                      order=IO.ARRIVAL).awaitTermination()
    tail = {(r.run_id, r.line_no): r.line for r in T.read_tail(spark, ck, 30).collect()}
    assert tail == {k: v for k, v in got.items() if k[1] > 70}


@pytest.mark.parametrize("quoted", [False, True])
def test_edge_ids_for_any_split_size(spark, quoted):
    d = folder("csv")
    geometry = '"LINESTRING (0 0, 1 1)"' if quoted else ""
    n = 0
    for i in range(3):
        with open(f"{d}/{i}.csv", "w") as fh:
            fh.write("from,to,delta_i,delta_tau,Ijk,geometry\n")
            for _ in range((200, 0, 150)[i]):
                n += 1
                fh.write(f"{n},{n + 1},1,1,{n},{geometry}\n")
    for size in (90, 5000, 1 << 27):
        with split_size(spark, size):
            got = sorted((r["edge_id"], int(r["from"])) for r in IO.read_edges(spark, d).collect())
        assert got == [(k, k) for k in range(1, n + 1)]


def test_views_are_numbered_by_their_ends(spark):
    spark.createDataFrame([(5, 6), (1, 2), (3, 4)], "from long, to long").createOrReplaceTempView("arcweave_some_edges")
    got = {r["from"]: r["edge_id"] for r in IO.read_edges(spark, "arcweave_some_edges", "table").collect()}
    assert got == {1: 1, 3: 2, 5: 3}


def test_blocks_follow_the_files_not_the_bytes(spark):
    d = folder("blocks")
    for i in range(3):
        with open(f"{d}/{i}.log", "w") as fh:
            fh.writelines(f"{i}-{k:06d}-{'x' * 90}\n" for k in range(30_000))
    with small_blocks(spark, d, 1 << 10):
        log = spark.read.text(d).select("value", "_metadata")
        tasks = log.rdd.getNumPartitions()
        got = number_rows(log, "n").orderBy("n").select(F.substring("value", 1, 8).alias("v")).collect()
    assert 3 < tasks <= 3 * (BLOCKS_A_FILE + 1)
    assert [r.v for r in got] == [f"{i}-{k:06d}" for i in range(3) for k in range(30_000)]


def test_edge_files_are_written_by_all_partitions(spark):
    """A2: the files of the query, and so the tasks that write and number them, grow with the session's partitions."""
    all_queries()["a2_csv_edge_ids"].run(spark, SF_SMALL)
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    newest = max((f"{base}/{n}" for n in os.listdir(base) if n.startswith("edges-csv-")), key=os.path.getmtime)
    files = [n for n in os.listdir(newest) if n.endswith(".csv")]
    assert len(files) == int(spark.conf.get("spark.sql.shuffle.partitions"))
