"""Groups of spelling variants by a dictionary of pairs of trie nodes.

All words of a dictionary that differ by exactly one inserted, deleted or replaced code point are found
exactly and without comparing words. Every prefix of a word is a node of a trie, every suffix a
node of the trie of the reversed words, and nodes are numbers. A word of length L gives

* for each position i the pair (node of the prefix before i, node of the suffix after i): the word with
  position i skipped;
* for each gap i the pair (node of the prefix before i, node of the suffix from i on): the word itself.

Two words with an equal skipped pair differ by a replaced code point; a gap pair of one that equals a
skipped pair of the other means that the other has one more. A pair of nodes stands for one string only, so
no match needs a check. A skipped pair can be shared by at most one word for each letter of the alphabet, a gap pair
belongs to one word, so groups of the join are bounded by the alphabet and have no hot key. Where
letters repeat (``hello`` without either ``l``), only the first of equal neighbouring positions counts.

Numbering (``trie_paths``): the words are range partitioned and sorted. In that order a word shares the
nodes up to its common prefix with the word before and begins new ones after it, so one streaming pass
with one path in memory numbers the nodes of a partition. A node that several partitions hold
is a prefix of the last word of one and the first word of the next; these few words, two a partition, give each
such node its number in the first of its partitions.

``variants`` adds the spelling policy: the form of a word is its near word with the largest count (of equal
ones the smallest in code-point order), if that is at least ``ratio`` times its own; the root follows the forms
to the last. Counts at least double on the way, so a chain has at most 62 steps and is
followed in six rounds of pointer jumping.

Defined results: null words and words of count null are no words; repeated words add their counts; null, blank or empty
texts have no runs; a null key is written as an empty text before the colon; the word of a run that is
shorter than ``LEAST_CHARS`` is left out; an empty table gives an empty result; further columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import n_partitions, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP = 97  # a run whose hash this divides loses a code point
LEAST_CHARS, LEAST_COUNT = 5, 3
RATIO = 2
BATCH = 1 << 18  # nodes in a batch of paths
ROUNDS = 6  # 2^6 steps, more than counts can double


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: letter runs of all texts, lower-cased A to Z, some with one code point less by a hash of key and run.

    Counts are combined before the shuffle, so a frequent word is one row of each task.
    """
    lower = F.translate(F.col(text), UPPER, LOWER)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    runs = docs.select(name.alias("name"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("name", F.lit(":"), "run").cast("binary"))
    size = F.length("run")
    at = (F.col("h") % size).cast("int")
    runs = runs.filter(size >= least_chars).withColumn("h", h)
    word = F.when(F.col("h") % DROP == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
                  ).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).filter(F.length("word") >= least_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count))


# ---------------------------------------------------------------- numbers of trie nodes


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] equal, a[:hi] not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _number(part: int, rows: Iterator[str]) -> Iterator[tuple[str, list[int]]]:
    """(word, node of each prefix, the empty one first) of sorted words; the root is 0."""
    before, path, count = "", [0], part << 33
    for word in rows:
        keep = _shared(before, word)
        fresh = len(word) - keep
        path = path[:keep + 1] + list(range(count + 1, count + fresh + 1))
        count += fresh
        before = word
        yield word, path


def trie_paths(words: DataFrame, word: str = "word", parts: int | None = None) -> DataFrame:
    """word, path: numbers of the trie nodes of all prefixes of each distinct word (array of long), the root first."""
    parts = parts or n_partitions(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        given: list[tuple] = []
        size = 0
        for w, path in _number(part, (x.as_py() for b in batches for x in b.column(0))):
            given.append((part, w, path))
            size += len(path)
            if size >= BATCH:
                yield _batch(given)
                given, size = [], 0
        if given:
            yield _batch(given)

    def _batch(given):
        p, w, path = zip(*given)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(w, pa.string()),
                                           pa.array(path, pa.list_(pa.int64()))], names=["part", "word", "path"])

    local = stored(words.select(F.col(word).alias("word")).repartitionByRange(parts, "word")
                   .sortWithinPartitions("word").mapInArrow(run, "part int, word string, path array<long>"), "trie")
    # the first and the last word of each partition: the only ones whose nodes partitions share
    ends = local.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"),
                                     F.min_by("path", "word").alias("a"), F.max_by("path", "word").alias("b"))
    each = (ends.select("part", F.col("first").alias("word"), F.col("a").alias("path"), F.lit(True).alias("head"))
            .unionByName(ends.select("part", F.col("last").alias("word"), F.col("b").alias("path"),
                                     F.lit(False).alias("head"))))
    node = each.select("part", "head", "word", F.posexplode("path").alias("depth", "node")).filter("depth > 0").select(
        "part", "head", F.substring("word", F.lit(1), F.col("depth")).alias("prefix"), "depth", "node")
    one = node.groupBy("prefix").agg(F.min("node").alias("to"))  # numbers grow with the partition
    change = (node.filter("head").join(one, "prefix").filter(F.col("node") != F.col("to"))
              .groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("node", "to"))).alias("change")))
    # one row a partition; the shared nodes of a path are its first ones
    return (local.join(change, "part", "left")
            .select("word", F.when(F.col("change").isNull(), F.col("path")).otherwise(
                F.transform("path", lambda x: F.coalesce(F.element_at("change", x), x))).alias("path")))


# ---------------------------------------------------------------- neighbours


def _numbered(words: DataFrame, parts: int) -> DataFrame:
    """word, n, and the node paths of the word and of the reversed word; stored."""
    back = trie_paths(words.select(F.reverse("word").alias("word")), parts=parts).select(
        F.reverse("word").alias("word"), F.col("path").alias("ends"))
    return stored(words.join(trie_paths(words, parts=parts), "word").join(back, "word"), "node-paths")


def _links(numbered: DataFrame) -> DataFrame:
    """(id, near, near_n): for each word, named by its last prefix node, every near word with its count."""
    size = F.length("word")
    ident = F.element_at("path", -1).alias("id")
    base = numbered.select("word", "n", "path", "ends", ident, size.alias("size"))
    skip = base.select("id", "n", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.col("size")),
        lambda i: F.struct(F.element_at("path", i).alias("p"), F.element_at("ends", F.col("size") - i + 1).alias("s"),
                           # the code point differs from the one before
                           ((i == 1) | (F.substring("word", i, F.lit(1)) != F.substring("word", i - 1, F.lit(1)))
                            ).alias("new")))).alias("i", "x")).select("id", "n", "x.*")
    gap = base.select("id", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("size") + 1),
        lambda i: F.struct(F.element_at("path", i).alias("p"), F.element_at("ends", F.col("size") - i + 2).alias("s")))
        ).alias("x")).select("id", "n", "x.*")
    rows = skip.withColumn("gap", F.lit(False)).unionByName(
        gap.withColumn("new", F.lit(True)).withColumn("gap", F.lit(True)))
    # one group for each pair of nodes: words that skip a position there, and the one word that is the pair
    groups = rows.groupBy("p", "s").agg(
        F.collect_list(F.when(~F.col("gap"), F.struct("id", "n", "new"))).alias("skips"),
        F.max(F.when(F.col("gap"), F.struct("id", "n"))).alias("whole")).filter(
        (F.size("skips") > 1) | ((F.size("skips") > 0) & F.col("whole").isNotNull()))
    groups = stored(groups.select("skips", "whole"), "node-pairs")
    replaced = (groups.select("skips", F.explode("skips").alias("a")).select("a", F.explode("skips").alias("b"))
                .filter(F.col("a.id") != F.col("b.id"))
                .select(F.col("a.id").alias("id"), F.col("b.id").alias("near"), F.col("b.n").alias("near_n")))
    longer = (groups.filter(F.col("whole").isNotNull()).select("whole", F.explode("skips").alias("a"))
              .filter("a.new"))
    return (replaced
            .unionByName(longer.select(F.col("whole.id").alias("id"), F.col("a.id").alias("near"), F.col("a.n").alias("near_n")))
            .unionByName(longer.select(F.col("a.id").alias("id"), F.col("whole.id").alias("near"), F.col("whole.n").alias("near_n"))))


def neighbours(words: DataFrame, parts: int | None = None) -> DataFrame:
    """word, near: all ordered pairs of distinct words of ``words`` that differ by one code point."""
    one = words.filter(F.col("word").isNotNull()).select("word").distinct().withColumn("n", F.lit(1).cast("long"))
    numbered = _numbered(stored(one, "words"), parts or n_partitions(words.sparkSession))
    name = numbered.select(F.element_at("path", -1).alias("id"), "word")
    return (_links(numbered).join(name, "id").select("near", "word")
            .join(name.select(F.col("id").alias("near"), F.col("word").alias("near_word")), "near")
            .select("word", F.col("near_word").alias("near")))


def variants(words: DataFrame, ratio: int = RATIO, parts: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of a table (word, n)."""
    parts = parts or n_partitions(words.sparkSession)
    words = stored(words.filter(F.col("word").isNotNull() & F.col("n").isNotNull())
                   .groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    numbered = _numbered(words, parts)
    links = _links(numbered)
    name = numbered.select(F.element_at("path", -1).alias("id"), "word", "n")
    # of equal counts the smallest word: every near word's text is looked up once, where it can be the form
    top = links.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.max("near_n").alias("top"))
    best = links.join(top.select("id", "top"), "id").filter(F.col("near_n") == F.col("top"))
    best = (best.join(name.select("id", F.col("n").alias("own")), "id").filter(F.col("near_n") >= ratio * F.col("own"))
            .join(name.select(F.col("id").alias("near"), F.col("word").alias("near_word")), "near")
            .groupBy("id").agg(F.min(F.struct("near_word", "near", "near_n")).alias("form")))
    out = stored(name.join(top.select("id", "n_near"), "id", "left").join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("form.near_word").alias("form"),
        F.col("form.near_n").alias("form_n"), F.col("form.near").alias("next")), "forms")
    jump = out.filter(F.col("next").isNotNull()).select("id", F.col("next").alias("to"))
    for _ in range(ROUNDS):
        ahead = jump.select(F.col("id").alias("to"), F.col("to").alias("further"))
        moved = jump.join(ahead, "to", "left")
        jump = stored(moved.select("id", F.coalesce("further", "to").alias("to"),
                                   F.col("further").isNotNull().alias("moved")), "roots")
        if not jump.filter("moved").limit(1).count():
            break
        jump = jump.drop("moved")
    root = jump.select("id", "to").join(name.select(F.col("id").alias("to"), F.col("word").alias("root")), "to")
    return (out.join(root.select("id", "root"), "id", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
