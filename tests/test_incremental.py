"""Growing networks and result versions: every step equals a full run."""

import glob
import json
import os
import random
import tempfile

import pytest
from pyspark.sql.types import StructType

from arcweave.operators.graph import connected_components, extend_components
from arcweave.plans import incremental as I
from arcweave.plans.results import edge_table
from arcweave.sources.fixtures import NetworkTables
from arcweave.streaming import rebuild as RB

EDGE = "from long, to long, delta_i double, delta_tau double, Ijk double, Iu double"


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    return sorted((n, find(n)) for n in parent)


def test_components_after_each_step_of_a_random_sequence(spark):
    rng = random.Random(3)
    nodes, edges = list(range(1, 60)), []
    now = spark.createDataFrame([(n, n) for n in nodes], "node long, component long")
    for step in range(6):
        # ends up to 70: some edges bring nodes that were not known; loops and repeats too
        part = [(rng.randrange(1, 71), rng.randrange(1, 71)) for _ in range((0, 1, 12, 12, 25, 12)[step])]
        part += part[:2] + [(5, 5)] * (step == 2)
        edges += part
        now = extend_components(now, spark.createDataFrame(part, "from long, to long")).checkpoint()
        want = union_find(nodes, edges)
        assert sorted(map(tuple, now.collect())) == want
    full = connected_components(now.select("node"), spark.createDataFrame(edges, "from long, to long"))
    assert sorted(map(tuple, full.collect())) == want


def network(rng, n, iu=True):
    pairs = sorted({tuple(sorted(rng.sample(range(1, 30), 2))) for _ in range(n)})
    return [(a, b, 1.0 + a, 0.1, float(rng.randrange(5, 50)), 60.0 if iu and (a + b) % 3 else None) for a, b in pairs]


def allocations(spark, rows, extra=()):
    infra = [("r", x, y, i * 1.5 + x) for a, b, _, _, i, _ in rows for x, y in ((a, b), (b, a))]
    flow = [("r", a, b, 1 + (a + b) % 2, float(a * b)) for a, b, *_ in rows]
    return (spark.createDataFrame(infra + list(extra), "run_id string, src long, dst long, ijk double"),
            spark.createDataFrame(flow, "run_id string, src long, dst long, good int, q double"))


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                  for r in df.select(*sorted(df.columns)).collect())


def full(spark, edges, infra, flow):
    return rows_of(edge_table(NetworkTables(None, spark.createDataFrame(edges, EDGE)), infra, flow, None, 2))


@pytest.mark.parametrize("iu", [True, False])
def test_versions_equal_full_results_and_touch_changed_buckets(spark, iu):
    rng = random.Random(4)
    path = tempfile.mkdtemp(prefix="arcweave-inc-", dir="/tmp")
    a = network(rng, 80, iu)
    infra, flow = allocations(spark, a + network(rng, 30, iu))
    b = [(f, t, d, x, i + (9.0 if f == 3 else 0.0), u) for f, t, d, x, i, u in a if (f + t) % 17]
    c = [*b, (1, 29, 1.0, 0.2, 400.0, None), b[0], b[0]]  # a new edge that moves the cap, and a repeated one
    touched = []
    for version, edges in enumerate((a, b, b, c), start=1):
        df = spark.createDataFrame(edges, EDGE).repartition(3)
        touched.append(I.publish_edges(df, infra, flow, path, version, 2, f"u{version}", buckets=16))
        files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/facts/**/*.parquet", recursive=True)}
        for v, e in enumerate((a, b, b, c)[:version], start=1):
            got = I.read_edges_version(spark, path, v)
            assert {r.version for r in got.select("version").distinct().collect()} == {v}
            assert rows_of(got.drop("version")) == full(spark, e, infra, flow)
    assert len(touched[0]) == 16 and touched[2] == [] and 0 < len(touched[3]) <= 2
    # publishing a version again changes nothing
    assert I.publish_edges(spark.createDataFrame(c, EDGE), infra, flow, path, 4, 2, "u4", buckets=16) == touched[3]
    assert rows_of(I.read_edges_version(spark, path).drop("version")) == full(spark, c, infra, flow)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/facts/at=1/**/*.parquet", recursive=True)}
    assert all(files[f] == t for f, t in after.items())
    with pytest.raises(FileNotFoundError):
        I.read_edges_version(spark, path, 9)


def test_only_complete_uploads_are_published(spark):
    base = tempfile.mkdtemp(prefix="arcweave-up-", dir="/tmp")
    src, man, sink, ck = (f"{base}/{n}" for n in ("src", "man", "sink", "ck"))
    os.makedirs(man)
    rng = random.Random(5)
    a, b = network(rng, 40), network(rng, 50)
    infra, flow = allocations(spark, a + b)
    schema = StructType.fromDDL(EDGE)

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/upload={name}")

    def announce(name, files, rows):
        with open(f"{man}/{name}.json", "w") as fh:
            fh.write(json.dumps({"upload": name, "n_files": files, "n_rows": rows}))

    def go():
        RB.stream_rebuild(spark, src, schema, man, sink, ck, RB.f1_publisher(infra, flow, sink, 2, 8),
                          available_now=True).awaitTermination()
        return I.newest(spark, sink)

    put("a", a[:10])
    announce("a", 2, len(a))
    assert go() == 0  # a file is missing
    put("b", b)
    announce("b", 1, len(b) + 1)  # a row is missing: never complete
    assert go() == 0
    put("a", a[10:])
    assert go() == 1
    announce("c", 1, len(b))  # announced before its files
    assert go() == 1
    put("c", b)
    assert go() == 2
    assert go() == 2  # nothing new
    for version, edges in ((1, a), (2, b)):
        assert rows_of(I.read_edges_version(spark, sink, version).drop("version")) == full(spark, edges, infra, flow)
    known = I.versions(spark, sink).select("version", "upload").distinct().collect()
    assert sorted(map(tuple, known)) == [(1, "a"), (2, "c")]


def test_pairs_of_a_first_version_are_not_compared(spark):
    """All pairs of a first version are new, so nothing is hashed; two versions are compared without decimals."""
    pairs = spark.createDataFrame([(1, 2, 5.0), (1, 2, 5.0), (1, 3, 5.0), (2, 3, -1.0)], "pair_lo long, pair_hi long, x double")
    first = I.changed_pairs(None, pairs, ["x"])
    assert "xxhash64" not in first._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, first.collect())) == [(1, 2), (1, 3), (2, 3)]
    later = spark.createDataFrame([(1, 2, 5.0), (1, 3, 5.0), (2, 3, -1.5), (4, 5, None)], pairs.schema)
    both = I.changed_pairs(pairs, later, ["x"])
    assert "decimal" not in both._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, both.collect())) == [(1, 2), (2, 3), (4, 5)]
