"""Registered queries: solver-log parsing, windows and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcweave.checks import sql_variants as SV
from arcweave.checks import sqlparts as S
from arcweave.checks.q_results import F1_DOUBLES
from arcweave.checks.registry import register, small_blocks
from arcweave.functions import parse_progress
from arcweave.operators import windows as W
from arcweave.plans import incremental
from arcweave.session import ensure_checkpoint_dir, scratch_dir
from arcweave.sources import files as IO
from arcweave.sources import fixtures as X
from arcweave.sources import logstore as LS
from arcweave.sources import variants as VA
from arcweave.streaming import latest as L
from arcweave.streaming import rebuild as RB
from arcweave.streaming import runlog as R
from arcweave.streaming import tail as T

CT = SV.RUNLOG

PROG = r"Iteration No\. (\d+) distance=([0-9.eE+-]+)"
TAIL_N = 20


def _parsed_sql(src: str = "runlog_n") -> str:
    it = f"TRY_CAST(regexp_extract(line, '{PROG}', 1) AS BIGINT)"
    d = (f"CASE WHEN regexp_matches(line, '{PROG}') THEN "
         f"TRY_CAST(regexp_extract(line, '{PROG}', 2) AS DOUBLE) END")
    return (f"SELECT *, CASE WHEN {it} IS NOT NULL AND {d} IS NOT NULL THEN {it} END AS iteration, "
            f"CASE WHEN {it} IS NOT NULL AND {d} IS NOT NULL THEN {d} END AS distance FROM {src}")


def _log(spark, sf_dir):
    return VA.run_log_lines(spark, sf_dir)


@register("c24_parse_progress", f"SELECT run_id, event_id, iteration, distance FROM "
          f"({_parsed_sql('runlog')}) p", ("distance",), ctes=CT)
def c24_parse_progress(spark, sf_dir):
    p = _log(spark, sf_dir).select("run_id", "event_id", parse_progress("line").alias("p"))
    return p.select("run_id", "event_id", "p.iteration", "p.distance")


@register("h2_number_lines", "SELECT run_id, event_id, line, line_no FROM runlog_n", ctes=CT)
def h2_number_lines(spark, sf_dir):
    return R.number_lines(_log(spark, sf_dir)).select("run_id", "event_id", "line", "line_no")


RETAIN_SQL = (f"SELECT run_id, event_id, line, line_no, greatest(total - {TAIL_N}, 0) AS offset "
              f"FROM (SELECT *, max(line_no) OVER (PARTITION BY run_id) AS total FROM runlog_n) t "
              f"WHERE line_no > total - {TAIL_N}")


@register("h3_retain_last", RETAIN_SQL, ctes=CT)
def h3_retain_last(spark, sf_dir):
    return W.retain_last(R.number_lines(_log(spark, sf_dir)), TAIL_N).select(
        "run_id", "event_id", "line", "line_no", "offset")


@register("h4_lines_since", f"""
    SELECT r.run_id, r.event_id, r.line, r.line_no, r.offset FROM ({RETAIN_SQL}) r
    WHERE r.line_no > greatest(r.run_id % 70, r.offset)""", ctes=CT)
def h4_lines_since(spark, sf_dir):
    log = R.number_lines(_log(spark, sf_dir))
    kept = W.retain_last(log, TAIL_N)
    cursors = log.select("run_id").distinct().select("run_id", (F.col("run_id") % 70).alias(
        "after"))
    return W.lines_since(kept, cursors).select("run_id", "event_id", "line", "line_no", "offset")


def _stored_log(spark, sf_dir):
    path = scratch_dir(spark, "log-store")
    LS.write_log(R.number_lines(_log(spark, sf_dir)), path, 8)
    return path


@register("h3_stored_tail", RETAIN_SQL, ctes=CT)
def h3_stored_tail(spark, sf_dir):
    """The retained tail of a stored log: files that hold only older lines are not opened."""
    return LS.read_since(spark, _stored_log(spark, sf_dir), 0, TAIL_N).select(
        "run_id", "event_id", "line", "line_no", "offset")


@register("h4_stored_cursor", f"""
    SELECT r.run_id, r.event_id, r.line, r.line_no, r.offset FROM ({RETAIN_SQL}) r
    WHERE r.line_no > greatest(r.run_id % 70, r.offset)""", ctes=CT)
def h4_stored_cursor(spark, sf_dir):
    path = _stored_log(spark, sf_dir)
    cursors = LS.run_totals(spark, path).select("run_id", (F.col("run_id") % 70).alias("after"))
    return LS.read_since(spark, path, cursors, TAIL_N).select("run_id", "event_id", "line", "line_no", "offset")


@register("h5_latest_progress", f"""
    SELECT run_id, arg_max(iteration, line_no) AS iteration, arg_max(distance, line_no) AS distance,
           arg_max(iteration, line_no) / 200.0 AS share
    FROM ({_parsed_sql()}) p WHERE iteration IS NOT NULL GROUP BY run_id""",
          ("distance", "share"), ctes=CT)
def h5_latest_progress(spark, sf_dir):
    return W.latest_progress(R.number_lines(_log(spark, sf_dir)), max_iter=200)


@register("h6_convergence", f"""
    SELECT run_id, line_no, iteration, distance,
           distance - lag(distance) OVER (PARTITION BY run_id ORDER BY line_no) AS change,
           min(CASE WHEN distance < 5.0 THEN iteration END) OVER (PARTITION BY run_id)
             AS first_converged
    FROM ({_parsed_sql()}) p WHERE iteration IS NOT NULL""", ("distance", "change"), ctes=CT)
def h6_convergence(spark, sf_dir):
    return W.convergence(R.number_lines(_log(spark, sf_dir)), tol=5.0).select(
        "run_id", "line_no", "iteration", "distance", "change", "first_converged")


@register("i5_run_status", """
    SELECT * FROM (WITH m AS (SELECT run_id, event_id, CASE
          WHEN regexp_matches(line, '^\\[app\\] Solve FAILED') THEN 'failed'
          WHEN regexp_matches(line, '^\\[app\\] Abort requested') THEN 'aborted'
          WHEN regexp_matches(line, '^\\[app\\] Solve finished in ') THEN 'finished' END AS kind
        FROM runlog),
      c AS (SELECT run_id, event_id, kind, lag(kind) OVER (PARTITION BY run_id ORDER BY event_id) AS before
            FROM m WHERE kind IS NOT NULL),
      s AS (SELECT run_id, arg_max(CASE WHEN kind = 'failed' AND before = 'aborted' THEN 'aborted'
                                        ELSE kind END, event_id) AS status,
                   max(event_id) AS closed_at FROM c GROUP BY run_id)
    SELECT r.run_id, coalesce(s.status, 'running') AS status, s.closed_at
    FROM (SELECT DISTINCT run_id FROM runlog) r LEFT JOIN s ON s.run_id = r.run_id) i5""",
          ctes=CT)
def i5_run_status(spark, sf_dir):
    return R.run_status(_log(spark, sf_dir))


def _write_parts(log, parts: int = 3):
    """Write the log as ``parts`` sequential drops into one folder (arrival order)."""
    bounds = log.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    tagged = log.crossJoin(F.broadcast(bounds)).withColumn(
        "part", F.least(F.floor((F.col("event_id") - F.col("lo")) * parts
                                / (F.col("hi") - F.col("lo") + 1)), F.lit(parts - 1)))
    for p in range(parts):
        yield tagged.filter(F.col("part") == p).select("run_id", "event_id", "line")


@register("a10_read_run_log", "SELECT run_id, event_id, line FROM runlog", ctes=CT)
def a10_read_run_log(spark, sf_dir):
    d = scratch_dir(spark, "runlog-json")
    _log(spark, sf_dir).write.mode("overwrite").json(d)
    return IO.read_run_log(spark, d)


def _text(log):
    """The log as text lines that name their run, in ``event_id`` order over the files."""
    files = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (log.repartitionByRange(files, "event_id").sortWithinPartitions("event_id")
            .select(F.concat(F.lit("[run "), F.col("run_id"), F.lit("] "), F.col("line")).alias("value")))


@register("a10_read_text_log", """
    SELECT run_id, row_number() OVER (ORDER BY event_id) AS event_id, line, line_no FROM runlog_n""", ctes=CT)
def a10_read_text_log(spark, sf_dir):
    """Plain text, read in small blocks: arrival numbers over all files, and line numbers per run."""
    d = scratch_dir(spark, "runlog-text")
    _text(_log(spark, sf_dir)).write.text(d)
    with small_blocks(spark, d, 64 << 10):
        log = IO.read_text_log(spark, d)
    return R.number_lines(log).select("run_id", "event_id", "line", "line_no")


@register("i3_text_tail", f"SELECT r.run_id, r.line, r.line_no, r.offset FROM ({RETAIN_SQL}) r", ctes=CT)
def i3_text_tail(spark, sf_dir):
    """The retained tail of text logs, as a stream of three drops."""
    src, ck = (scratch_dir(spark, n) for n in ("i3-text", "i3-text-ck"))
    for part in _write_parts(_log(spark, sf_dir)):
        _text(part).write.mode("append").text(src)
        T.stream_tail(IO.read_text_log(spark, src, streaming=True), ck, n=TAIL_N, available_now=True,
                      order=IO.ARRIVAL).awaitTermination()
    return T.read_tail(spark, ck, TAIL_N).select("run_id", "line", "line_no", "offset")


@register("i1_stream_progress", f"""
    SELECT run_id, arg_max(iteration, event_id) AS iteration,
           arg_max(distance, event_id) AS distance, max(event_id) AS at
    FROM ({_parsed_sql('runlog')}) p WHERE iteration IS NOT NULL GROUP BY run_id""",
          ("distance",), ctes=CT)
def i1_stream_progress(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    src, sink, ck = (scratch_dir(spark, n) for n in ("i1-src", "i1-sink", "i1-ck"))
    for part in _write_parts(_log(spark, sf_dir)):
        part.write.mode("append").json(src)
        stream = IO.read_run_log(spark, src, streaming=True)
        q = R.stream_progress(stream, ck, sink_path=sink, available_now=True)
        q.awaitTermination()
    return L.read_latest(spark, sink)


@register("i3_stream_tail", RETAIN_SQL, ctes=CT)
def i3_stream_tail(spark, sf_dir):
    """Three batches; the tail is read from the state store after the last."""
    src, ck = (scratch_dir(spark, n) for n in ("i3-src", "i3-ck"))
    for part in _write_parts(_log(spark, sf_dir)):
        part.write.mode("append").json(src)
        stream = IO.read_run_log(spark, src, streaming=True)
        T.stream_tail(stream, ck, n=TAIL_N, available_now=True).awaitTermination()
    return T.read_tail(spark, ck, TAIL_N)


_i4a_ctes, _i4a = S.edge_table("result", prefix="i4a")
_I4_EDGES = [("i4edges", """SELECT * REPLACE (CASE WHEN ("from" + "to") % 10 = 0 THEN Ijk + 5 ELSE Ijk END AS Ijk,
    CASE WHEN ("from" + "to") % 15 = 0 THEN CAST(130 AS DOUBLE) ELSE Iu END AS Iu)
    FROM tedges WHERE ("from" + "to") % 31 <> 0""")]
_i4b_ctes, _i4b = S.edge_table("result", edges="i4edges", prefix="i4b")


@register("i4_stream_rebuild", f"""
    SELECT *, CAST(1 AS BIGINT) AS version FROM ({_i4a}) a
    UNION ALL SELECT *, CAST(2 AS BIGINT) AS version FROM ({_i4b}) b""", F1_DOUBLES,
          ctes=S.NET_T + _I4_EDGES + _i4a_ctes + _i4b_ctes)
def i4_stream_rebuild(spark, sf_dir):
    """Two complete uploads in three batches; between them a partial one, which publishes nothing.

    The second upload changes, drops and keeps edges and raises the cap; each version equals the full F1 of
    its edges.
    """
    src, manifests, sink, ck = (scratch_dir(spark, n) for n in ("i4-edges", "i4-manifests", "i4-sink", "i4-ck"))
    net = X.trade_network(spark, sf_dir)
    alloc = X.trade_allocations(spark, sf_dir, net, paired=True)
    run = F.col("run_id") == "result"
    publish = RB.f1_publisher(alloc.arc_infra.filter(run), alloc.arc_flow.filter(run), sink, X.N_GOODS_FROM_PARTS,
                              buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))  # those of the arcs
    first = net.edges.drop("geometry")
    s = F.col("from") + F.col("to")
    second = (first.filter(s % 31 != 0)
              .withColumn("Ijk", F.when(s % 10 == 0, F.col("Ijk") + 5).otherwise(F.col("Ijk")))
              .withColumn("Iu", F.when(s % 15 == 0, F.lit(130.0)).otherwise(F.col("Iu"))))

    def upload(name, edges):
        edges.write.mode("append").option("compression", "zstd").parquet(f"{src}/upload={name}")

    def announce(name):
        files = spark.read.schema(first.schema).parquet(f"{src}/upload={name}").select(
            F.col("_metadata.file_path").alias("file"))
        files.agg(F.lit(name).alias("upload"), F.count_distinct("file").alias("n_files"),
                  F.count("file").alias("n_rows")).write.mode("append").json(manifests)

    def run_batch():
        RB.stream_rebuild(spark, src, first.schema, manifests, sink, ck, publish,
                          available_now=True).awaitTermination()

    upload("a", first)
    announce("a")
    run_batch()
    upload("b", second.filter(F.col("from") % 2 == 0))
    run_batch()
    if incremental.newest(spark, sink) != 1:
        raise AssertionError("a partial upload was published")
    upload("b", second.filter(F.col("from") % 2 != 0))
    announce("b")
    run_batch()
    return incremental.read_edges_version(spark, sink, 1).unionByName(incremental.read_edges_version(spark, sink, 2))
