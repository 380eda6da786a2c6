"""Weighted rendezvous hashing of record keys over shards.

Every (key, shard) pair gets a hash in (0, 1); a record goes to the shard with the largest
``-weight / ln(hash)``. The score of a pair does not depend on the other shards, so a new
shard only takes rows into itself and a removed one only gives its own rows away; a shard's
expected share is its part of the total weight.

Defined results: a null key is one more key (all such rows share a shard); equal keys share a
shard; a null text has no bytes; an empty table gives an empty result; further columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import n_partitions, stored
from arcweave.operators.windows import sequence_number

_UNIT = float(1 << 53)


def _score(key: Column, shard: int, weight: float) -> Column:
    # 53 bits of the hash as an odd number of 2^-54, so that it is never 0 or 1
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("long")), 11)
    return F.lit(-float(weight)) / F.log((bits.cast("double") + F.lit(0.5)) / F.lit(_UNIT))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard (int) of ``key`` among ``len(weights)`` shards; a tie goes to the smaller shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive and at least one shard is needed")
    # a struct compares by score first, then by the negated shard number
    best = F.array_max(F.array(*[
        F.struct(_score(key, s, w).alias("score"), F.lit(-s).alias("neg"))
        for s, w in enumerate(weights)]))
    return -best["neg"]


def assign_shards(df: DataFrame, weights: Sequence[float], key: str = "doc_id",
                  text: str = "text", grown: Sequence[float] | None = None) -> DataFrame:
    """One row per record: key, size, text_crc32, shard, slot and (with ``grown`` weights) grown_shard.

    ``slot`` numbers the records of a shard from 0 without gaps, in key order (ties in any
    order). The numbering is a range partitioning plus offsets per partition: a shard, or a
    key that a third of all rows carry, is spread over many tasks.
    """
    t = F.col(text)
    thin = df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("shard", rendezvous(F.col("key"), weights))
    thin = thin.withColumn(
        "grown_shard", rendezvous(F.col("key"), grown) if grown else F.lit(None).cast("int"))
    # the row number in the stored table breaks ties between equal keys for the range bounds
    thin = stored(thin, "shards").withColumn("tie", F.monotonically_increasing_id())
    seq = sequence_number(thin, ["shard", "key", "tie"], "seq", n_partitions(df.sparkSession))
    # one row for each shard
    first = seq.groupBy("shard").agg(F.min("seq").alias("first"))
    return (seq.join(F.broadcast(first), "shard")
            .select(F.col("key").alias(key), "size", "text_crc32", "shard",
                    (F.col("seq") - F.col("first")).cast("long").alias("slot"), "grown_shard"))


def write_shards(df: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """Write whole records as Parquet, one folder ``shard=N`` for each shard.

    A shard is written by as many tasks as hold rows of it; nothing is gathered.
    """
    df.withColumn("shard", rendezvous(F.col(key), weights)).write.partitionBy("shard").parquet(path)


def moved(assigned: DataFrame) -> DataFrame:
    """Rows and bytes that change their shard on growth, by old and new shard."""
    return (assigned.filter(F.col("shard") != F.col("grown_shard"))
            .groupBy("shard", "grown_shard")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes")))



