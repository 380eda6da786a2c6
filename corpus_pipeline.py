"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of
``documents``; the last returns their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import bpe_tree, decontaminate, line_dedup, near_dup, quality
from arcweave.llm.common import stored, table

RANKS = "byte_bpe_multi_50k.tiktoken"

#: The token ids of a document need a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that fail the base rules or a certified cutoff."""
    return quality.keep_documents(docs, table(spark, sf_dir, "labels"))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of repeated three-line windows; a document that loses all its words goes.

    Documents that lose nothing stay as they are. ``n_chars`` follows the text.
    """
    return line_dedup.without_repeats(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, the one with the smallest id."""
    return near_dup.one_per_class(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text's bytes."""
    coded = bpe_tree.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_text=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("exact"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_windows),
    ("near dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
