"""Benchmark decontamination: containment search of short items inside long documents.

An item is the set of its five-word shingles; a document contains it when at least 80 % of
them occur in it. A document is far larger than an item, so plain MinHash agreement says
nothing; the search uses the containment form of MinHash instead: the item keeps a sketch of
its smallest shingle hashes, and the complete shingle stream of every document is probed for
them. Items are partitioned by the power of two of their size, and each partition has its own
sketch size: with at most ``hi`` shingles in an item of the partition, a document that contains
it misses at most ``floor(0.2 * hi)`` of them, so a sketch of one more always has a hit and no
contained item is lost. Among an item's shingles, those that fewer items share come first (in
steps of powers of two), so a phrase that all items start with does not make every document a
candidate. Candidates are then checked by exact containment of the shingle texts.

Everything is DataFrame functions. The sketches are joined on the shingle hash: the planner
broadcasts the stored table when its size is under the session's threshold and shuffles
otherwise. Candidates are stored before the second pass for the same reason.

Words are runs of characters other than ASCII white space, compared unchanged. Defined results:
null, empty and short texts (under five words) have no shingle and match nothing, as item or
document; items with equal word sequences are one item under the smallest id, ``n_items`` says
how many; a null id is an id; of several rows with one document id the largest containment
counts; an empty table on either side gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import stored, words

SHINGLE = 5
PERCENT = 80  # share of an item's shingles that a document must hold


def _shingles(w: Column, k: int, one) -> Column:
    """``one`` applied to the ``k`` words from each word on; the word array is never read inside the lambda."""
    n = F.greatest(F.size(w) - F.lit(k - 1), F.lit(0))
    parts = F.arrays_zip(*[F.slice(w, F.lit(j), n).alias(f"w{j}") for j in range(1, k + 1)])
    return F.transform(parts, lambda x: one(*[x[f"w{j}"] for j in range(1, k + 1)]))


def _texts(w: Column, k: int) -> Column:
    """Shingles as words joined by a space (a word holds no space, so this is one to one)."""
    return _shingles(w, k, lambda *x: F.concat_ws(" ", *x))


def _hashes(w: Column, k: int) -> Column:
    return _shingles(w, k, F.xxhash64)


def item_sketches(items: DataFrame, key: str = "item_id", text: str = "text", k: int = SHINGLE,
                  percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(items with their shingle texts, sketches): one row per distinct word sequence; one per sketch hash."""
    base = (items.select(F.col(key).alias("item"), words(F.col(text)).alias("w"))
            .filter(F.size("w") >= k)
            .groupBy("w").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("n_items")))
    base = stored(base.select("item", "n_items", F.array_distinct(_texts(F.col("w"), k)).alias("shingles"),
                              F.array_distinct(_hashes(F.col("w"), k)).alias("hashes"))
                  .withColumn("item_no", F.xxhash64("shingles", "item")), "items")
    one = base.select("item_no", F.size("hashes").alias("n"), F.explode("hashes").alias("sh"))
    shared = one.groupBy("sh").agg(F.count(F.lit(1)).alias("df"))
    order = F.struct(F.floor(F.log2(F.col("df").cast("double"))).alias("step"),
                     F.xxhash64("sh", F.lit(17)).alias("rank"), F.col("sh"))
    # an item is a short text: its list is bounded by its own row
    lists = one.join(shared, "sh").groupBy("item_no", "n").agg(F.sort_array(F.collect_list(order)).alias("o"))
    hi = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1).cast("int") - 1
    size = F.lit(1) + F.floor(hi * F.lit(100 - percent) / F.lit(100)).cast("int")
    sketch = lists.select("item_no", F.explode(F.slice("o", F.lit(1), size)).alias("o")).select(
        "item_no", F.col("o.sh").alias("sh"))
    return base.drop("hashes"), sketch


def _checked(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, k: int,
             percent: int) -> DataFrame:
    """Rows (key, h: hash of the text) and items with the shingles they share, over the limit."""
    base, sketch = item_sketches(items, item_key, item_text, k, percent)
    sketch = stored(sketch, "sketches")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).filter("t is not null").select(
        "key", F.xxhash64("t").alias("h"), "t", words(F.col("t")).alias("w"))
    # the outer form adds no filter that would compute the array a second time; its nulls join nothing
    probes = rows.select("key", "h", F.explode_outer(_hashes(F.col("w"), k)).alias("sh"))
    found = stored(probes.join(sketch, "sh").select("key", "h", "item_no").distinct(), "candidates")
    pairs = found.join(base, "item_no").select(F.col("key").alias("ckey"), F.col("h").alias("ch"),
                                               "item", "n_items", "shingles")
    both = rows.drop("w").join(
        pairs, F.col("key").eqNullSafe(F.col("ckey")) & (F.col("h") == F.col("ch")))
    return (both.withColumn("w", words(F.col("t")))
            .withColumn("n_shared", F.size(F.array_intersect("shingles", _texts(F.col("w"), k))))
            .withColumn("n_shingles", F.size("shingles"))
            .filter(F.col("n_shared") * 100 >= F.col("n_shingles") * percent))


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                    item_key: str = "item_id", item_text: str = "text", k: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """Pairs (document, item) with ``n_shared`` of the item's ``n_shingles`` shingles, over the limit."""
    checked = _checked(docs, items, key, text, item_key, item_text, k, percent)
    return (checked.groupBy(F.col("key").alias(key), F.col("item").alias(item_key if item_key != key else "item"))
            .agg(F.max("n_items").alias("n_items"), F.max("n_shared").alias("n_shared"),
                 F.max("n_shingles").alias("n_shingles")))


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                    item_key: str = "item_id", item_text: str = "text", k: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """The documents that contain no item, with all their columns; rows of one key are told apart by their texts."""
    hit = stored(_checked(docs, items, key, text, item_key, item_text, k, percent)
                 .select(F.col("key").alias("__hit"), F.col("h").alias("__h")).distinct(), "hits")
    return docs.join(hit, docs[key].eqNullSafe(hit["__hit"]) & (F.xxhash64(docs[text]) == hit["__h"]), "left_anti")


def oracle_sql() -> str:
    return r"""
WITH i0 AS (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
i1 AS (SELECT w, min(item_id) AS item_id, count(*) AS n_items FROM i0 WHERE len(w) >= 5 GROUP BY w),
i2 AS (SELECT item_id, n_items, w, unnest(range(1, len(w) - 3)) AS p FROM i1),
i3 AS (SELECT DISTINCT item_id, n_items, w[p:p + 4] AS s FROM i2),
n AS (SELECT item_id, count(*) AS n_shingles FROM i3 GROUP BY item_id),
d0 AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
d1 AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d0 WHERE len(w) >= 5),
d2 AS (SELECT DISTINCT doc_id, w[p:p + 4] AS s FROM d1 SEMI JOIN i3 ON w[p:p + 4] = i3.s),
h AS (SELECT doc_id, item_id, n_items, count(*) AS n_shared FROM d2 JOIN i3 USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_items, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_shingles AS INTEGER) AS n_shingles
FROM h JOIN n USING (item_id) WHERE n_shared * 100 >= n_shingles * 80
"""
