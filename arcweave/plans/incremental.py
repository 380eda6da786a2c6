"""Versions of the edge result table (F1), kept by recomputing what changed.

A version is a full edge table. Its rows depend on the arcs of their own pair alone, except for the cap, which
is one number of the network. So a new version compares the pairs of the new edges with those of
the version before, by count and order-free checksum of each pair's rows, and recomputes only pairs that are
new or differ: the allocations are read for those pairs only. Rows are stored without the columns that follow
from the cap, in buckets by pair; a bucket without a changed pair is not written again. The new edges are dealt by pair
once; the version before, and allocations in as many buckets, are read where they lie. The version's
manifest, one small file written last, says which files hold each bucket and what the cap is, and makes the version visible.

Writing a version again, as after a failure, overwrites the same folders and gives the same rows. Files of
earlier versions stay, since those versions can still be read.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.operators.arcs import PAIR, pair_columns, with_pair
from arcweave.plans.results import edge_base, edge_facts, network_cap, with_upgrades
from arcweave.session import ensure_checkpoint_dir
from arcweave.sources.buckets import attach_by_pair, deal_by_pair, write_dealt

BUCKETS = 64
_MANIFEST = "version long, upload string, bucket int, at long, cap double"


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifests of all published versions; nothing where there is none yet, any other error is raised."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def newest(spark: SparkSession, path: str) -> int:
    """The last published version, 0 where there is none."""
    found = versions(spark, path)
    return 0 if found is None else found.agg(F.max("version")).first()[0] or 0


def _facts(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Stored rows of a version: each bucket from the files that hold it."""
    held = versions(spark, path).filter(F.col("version") == version).select("bucket", "at")
    parts = held.agg(F.collect_set("at")).first()[0]  # at most one number a bucket
    rows = spark.read.option("basePath", f"{path}/facts").parquet(*[f"{path}/facts/at={v}" for v in sorted(parts)])
    return rows.join(F.broadcast(held), ["bucket", "at"]).drop("at")  # one row a bucket


def _table(path: str, at: int) -> str:
    return "facts_" + hashlib.md5(f"{path}/facts/at={at}".encode()).hexdigest()


def _facts_by_pair(spark: SparkSession, path: str, version: int, buckets: int) -> DataFrame:
    """``_facts`` from tables in buckets by pair."""
    held = versions(spark, path).filter(F.col("version") == version).select("bucket", "at")
    parts = {r["at"]: r["bs"] for r in held.groupBy("at").agg(F.collect_list("bucket").alias("bs")).collect()}  # a number a bucket
    found = []
    for at, here in sorted(parts.items()):
        folder = f"{path}/facts/at={at}"
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema.fields)
        rows = attach_by_pair(spark, _table(path, at), folder, schema, buckets)
        found.append(rows.filter(F.col("bucket").isin(here)))
    return reduce(DataFrame.unionByName, found)


def _of_pairs(df: DataFrame, pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    keyed = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in PAIR], *pair_columns(df, a, b))
    return keyed.join(pairs.select(*PAIR), list(PAIR), "left_semi")


def _bucket(buckets: int) -> Column:
    """The bucket of a row in tables by pair."""
    return F.pmod(F.hash(*PAIR), F.lit(buckets)).cast("int").alias("bucket")


def changed_pairs(before: DataFrame | None, after: DataFrame, inputs: list[str]) -> DataFrame:
    """Pairs whose rows differ in ``inputs`` between two tables, as sets with repeats; also pairs of one table only.

    Each side is summed up by pair, where it lies if it is dealt so, and the sums are joined."""
    sums = ("n", "lo1", "hi1", "lo2", "hi2")

    def marked(df: DataFrame, suffix: str) -> DataFrame:
        # two hashes, each in halves of 32 bits, whose sums as longs are exact for 2^31 rows of a pair
        hashes = df.select(*PAIR, *[F.xxhash64(F.lit(seed), *inputs).alias(f"x{seed}") for seed in (1, 2)])
        halves = hashes.select(*PAIR, F.lit(1).cast("long").alias("n"), *[
            half.alias(f"{name}{seed}") for seed in (1, 2) for name, half in (
                ("lo", F.col(f"x{seed}").bitwiseAND(F.lit(0xFFFFFFFF))), ("hi", F.shiftright(f"x{seed}", 32)))])
        return halves.groupBy(*PAIR).agg(*[F.sum(c).alias(c + suffix) for c in sums])

    if before is None:  # all pairs are new
        return after.select(*PAIR).distinct()
    both = marked(after, "_a").join(marked(before, "_b"), list(PAIR), "full_outer")
    return both.filter(reduce(or_, [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in sums])).select(*PAIR)


def with_changes(before: DataFrame, after: DataFrame, inputs: list[str]) -> DataFrame:
    """The changed pairs with their rows of ``after``, marked ``_here``; a pair without any has one row without the mark.

    ``after`` is shuffled once for both: what deals it out has the same columns and filters in the two places.
    """
    return changed_pairs(before, after, inputs).join(after.withColumn("_here", F.lit(True)), list(PAIR), "left")


def publish_edges(edges: DataFrame, arc_infra: DataFrame, arc_flow: DataFrame | None, path: str, version: int,
                  n_goods: int = 1, upload: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Publish F1 of ``edges`` as ``version`` (above the newest, or the newest again); returns the buckets written.

    ``arc_infra`` and ``arc_flow`` are the allocations of one run, the same for all versions of ``path``.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    known = versions(spark, path)
    earlier = None if known is None else known.filter(F.col("version") < version).agg(F.max("version")).first()[0]
    before = None if earlier is None else _facts_by_pair(spark, path, earlier, buckets)
    inputs = [c for c in edge_base(edges).columns if c not in PAIR]
    base = edge_base(edges).filter(F.col("pair_lo").isNotNull() & F.col("pair_hi").isNotNull())
    dealt = deal_by_pair(base.drop(*PAIR), buckets, "from", "to")
    if before is None:  # all pairs are new: their edges and arcs are taken as they are, without a look-up of pairs
        changed = base
        parts = dealt.withColumnRenamed("Ijk_orig", "Ijk"), arc_infra, arc_flow
    else:
        found = with_changes(before, dealt, inputs).checkpoint()
        changed = found.select(*PAIR).distinct()
        parts = (found.filter("_here").drop("_here").withColumnRenamed("Ijk_orig", "Ijk"), _of_pairs(arc_infra, changed),
                 None if arc_flow is None else _of_pairs(arc_flow, changed))
    # at most ``buckets`` numbers
    touched = sorted(r[0] for r in changed.select(_bucket(buckets)).distinct().collect())
    if touched:
        rows = edge_facts(*parts, n_goods).withColumn("bucket", _bucket(buckets))
        if before is not None:
            kept = before.filter(F.col("bucket").isin(touched)).join(changed.select(*PAIR), list(PAIR), "left_anti")
            rows = rows.unionByName(kept)
        write_dealt(rows, _table(path, version), f"{path}/facts/at={version}", buckets)
    cap = network_cap(edges, arc_infra).select(F.max("cap").alias("cap"))
    held = spark.range(buckets).select(
        F.col("id").cast("int").alias("bucket"),
        F.when(F.col("id").isin(touched), F.lit(version)).cast("long").alias("new"))
    if earlier is not None:
        old = known.filter(F.col("version") == earlier).select("bucket", "at")
        held = held.join(old, "bucket", "left")
    else:
        held = held.withColumn("at", F.lit(None).cast("long"))
    (held.select("bucket", F.coalesce("new", "at").alias("at")).filter(F.col("at").isNotNull())
     .crossJoin(F.broadcast(cap))  # one row
     .select(F.lit(upload).cast("string").alias("upload"), "bucket", "at", "cap")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={version}"))
    return touched


def read_edges_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """F1 of a published version (the newest by default) with a column ``version``."""
    version = newest(spark, path) if version is None else version
    found = versions(spark, path)
    if found is None or found.filter(F.col("version") == version).isEmpty():
        raise FileNotFoundError(f"no published version {version} under {path}")
    cap = found.filter(F.col("version") == version).agg(F.max("cap").alias("cap"))
    rows = _facts(spark, path, version).drop("bucket")
    order = [*[c for c in rows.columns if c not in PAIR], *PAIR]
    return with_upgrades(rows.select(*order), cap).withColumn("version", F.lit(version).cast("long"))
