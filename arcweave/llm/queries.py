"""Registered queries of this subpackage: ``opN_<name>(spark, sf_dir)`` and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import (article, bpe_tree, decontaminate, frames, idcoder, line_dedup, near_dup, phrases,
                          quality, shard, spelling, syncmers, warc)
from arcweave.llm.common import table
from arcweave.session import ensure_checkpoint_dir, scratch_dir

SHARDS = 16
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def op1_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = scratch_dir(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    return warc.page_results(spark, path).drop("url")


def op2_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("h")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_tree.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE),
                                   public_tokenizers.PATTERN)
    return bpe_tree.digests(coded)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = scratch_dir(spark, "token-ids")
    idcoder.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return idcoder.read_ids(spark, path).select(
        "doc_id", "start", (F.octet_length("data") / 4).cast("long").alias("n_tokens"),
        F.crc32("data").alias("ids_crc32"))


def op10_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.successor_edits(table(spark, sf_dir, "documents"))


def op12_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_framed_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.fill_in_middle(frames.store(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_warc_captures, op2_article_text, op3_decontaminate, op4_line_dedup, op5_quality_rules,
    op6_tree_bpe, op7_order_minhash,
    op8_rendezvous_shards, op9_id_files, op10_repeated_phrases, op11_closed_syncmers, op12_trie_pairs,
    op13_framed_middle)}
ORACLES = {"op3_decontaminate": decontaminate.oracle_sql, "op4_line_dedup": line_dedup.oracle_sql}
