"""Removal of long passages that an earlier document has too, by repeated-phrase automata.

A passage is a window of ``WINDOW`` consecutive words. Each window chooses one phrase of
``PHRASE`` consecutive words in it, the one with the smallest hash, so equal windows choose equal
phrases; about one phrase in twenty words is chosen at all.

1. Every document gives its chosen phrases as hashes. A phrase recurs if two different texts
   chose it (an aggregation that combines before the shuffle).
2. Documents are dealt over parts of bounded size. A part gets the hashes of the recurring
   phrases of its own documents and compiles them into an Aho-Corasick automaton: the automata
   are shards of the set of all recurring phrases, each phrase only where it can occur, so work
   and memory of a part do not grow with the corpus.
3. All documents of the part stream through its automaton, which locates every occurrence of the
   phrases. A window whose phrase was located is a candidate and gets a 96-bit hash.
4. One aggregation over the candidates finds the smallest document of each window; a window that
   starts in a smaller document than its own covers its words, which are removed.

A text whose words equal those of an earlier document is decided by a digest of all its words
and gives no windows. Where equality counts, hashes have 96 bits (windows) or 128 bits (texts); the
64-bit phrase hashes only choose what is looked at, equally in all documents.

Words are runs of characters other than ASCII white space, unchanged. Defined results: null,
blank and short texts lose nothing; a null id is smaller than all others; rows with the same id
do not count as earlier than each other, and each is a row of the result; an empty table gives
an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import n_partitions, stored
from arcweave.llm.wordhash import U64, Words, chunks, digests, signed, split_words, text_buffer

WINDOW = 50
PHRASE = 8
PART_BYTES = 8 << 20  # text of a part
STEP_BYTES = 1 << 20  # text that is hashed at once
_LOW = U64(0xFFFFFFFF)
_NULL_ID = -(1 << 63)


def chosen(w: Words, h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase hash from each word on, window starts inside one document, word at which each chooses its phrase)."""
    g = w.windows(h, phrase)
    n = len(h) - window + 1
    if n <= 0:
        return g, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the upper half of the hash, then the position: the smallest of a window, leftmost of equal ones
    low = (g & ~_LOW) | np.arange(len(g), dtype=U64)
    span, step = window - phrase + 1, 1
    while step * 2 <= span:
        low = np.minimum(low[:len(low) - step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[:n], low[span - step:span - step + n])
    at = (low[:n] & _LOW).astype(np.int64)
    doc = w.doc_of_word()
    starts = np.flatnonzero(doc[:n] == doc[window - 1:])
    return g, starts, at[starts]


_CHOICE = "kind int, id long, h long, n_words long, a long, b long"


def _choices(df: DataFrame, window: int, phrase: int) -> DataFrame:
    """kind 0: a document with its digests a, b; kind 1: a phrase hash a that a document with digest b chose."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = text_buffer(batch.column(2))
            for i, j in chunks(offsets, STEP_BYTES):
                w = split_words(data, offsets[i:j + 1])
                h1, h2 = w.hashes(1), w.hashes(2)
                d1, d2 = digests(w, h1, h2)
                g, _, at = chosen(w, h1, window, phrase)
                at = at[np.flatnonzero(np.diff(at, prepend=-1))]
                doc = w.doc_of_word()[at]
                n = j - i
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array([0, 1], np.int32), [n, len(at)])),
                    pa.array(np.concatenate([ids[i:j], ids[i:j][doc]])),
                    pa.array(np.concatenate([own[i:j], own[i:j][doc]])),
                    pa.array(np.concatenate([np.diff(w.first), np.zeros(len(at), np.int64)])),
                    signed(np.concatenate([d1, g[at]])), signed(np.concatenate([d2, d1[doc]]))],
                    names=["kind", "id", "h", "n_words", "a", "b"])

    return df.mapInArrow(run, _CHOICE)


class _Part:
    """Documents of one part; ``finish`` gives their rows."""

    def __init__(self, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.copies: set[tuple[int, int]] = set()
        self.recurring: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.texts: list[pa.Array] = []

    def _measure(self, data, offsets, i, j):
        w = split_words(data, offsets[i:j + 1])
        h1 = w.hashes(1)
        return w, h1, *chosen(w, h1, self.window, self.phrase)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        ids = np.concatenate(self.ids)
        data, offsets = text_buffer(pa.concat_arrays(self.texts))
        recurring = np.sort(np.concatenate(self.recurring)) if self.recurring else np.zeros(0, U64)
        automaton = self._compile(data, offsets, recurring) if len(recurring) else None
        for i, j in chunks(offsets, STEP_BYTES):
            yield self._rows(data, offsets, i, j, ids, automaton)

    def _compile(self, data, offsets, recurring) -> ahocorasick.Automaton | None:
        """Automaton of the phrases, each as its words with a space around every word."""
        automaton, seen = ahocorasick.Automaton(), set()
        for i, j in chunks(offsets, STEP_BYTES):
            w, _, g, _, at = self._measure(data, offsets, i, j)
            at = at[np.flatnonzero(np.diff(at, prepend=-1))]
            slot = np.minimum(np.searchsorted(recurring, g[at]), len(recurring) - 1)
            for p in at[recurring[slot] == g[at]].tolist():
                x = int(g[p])
                if x not in seen:
                    seen.add(x)
                    span = w.data[w.start[p]:w.end[p + self.phrase - 1]].tobytes()
                    automaton.add_word(" " + b" ".join(span.split()).decode() + " ", 1)
        if not seen:
            return None
        automaton.make_automaton()
        return automaton

    def _locate(self, automaton, words: bytes, n: int) -> np.ndarray:
        """Words of a document at which a phrase starts."""
        text = f" {words.decode()} "
        ends = [e for e, _ in automaton.iter(text)]
        found = np.zeros(n, dtype=bool)
        if ends:
            gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 32)
            found[np.searchsorted(gaps, ends) - self.phrase] = True
        return found

    def _rows(self, data, offsets, i, j, ids, automaton) -> pa.RecordBatch:
        w, h1, _, starts, at = self._measure(data, offsets, i, j)
        h2 = w.hashes(2)
        d1, _ = digests(w, h1, h2)
        count = np.diff(w.first)
        located = np.zeros(len(h1), dtype=bool)
        shas, texts = [], []
        copy = np.zeros(j - i, dtype=bool)
        for d in range(j - i):
            a, b = w.first[d], w.first[d + 1]
            words = b" ".join(w.data[w.offsets[d]:w.offsets[d + 1]].tobytes().split())
            copy[d] = b - a >= self.window and (int(ids[i + d]), int(d1[d])) in self.copies
            if automaton is not None and not copy[d] and b - a >= self.window:
                located[a:b] = self._locate(automaton, words, b - a)
            texts.append(words)
        doc = w.doc_of_word()
        pick = located[at] & ~copy[doc[starts]] if len(starts) else np.zeros(0, dtype=bool)
        starts = starts[pick]
        per = np.bincount(doc[starts], minlength=j - i) if len(starts) else np.zeros(j - i, np.int64)
        wins = [w.windows(h, self.window, seed)[starts] if len(starts) else np.zeros(0, U64)
                for seed, h in ((1, h1), (2, h2))]
        for d in range(j - i):
            keep = per[d] > 0
            shas.append(None if keep else hashlib.sha256(b"" if copy[d] else texts[d]).hexdigest())
            if not keep:
                texts[d] = None
        ends = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (
            pa.array((starts - w.first[doc[starts]] if len(starts) else starts).astype(np.int32)),
            signed(wins[0]), pa.array((wins[1] >> U64(32)).astype(np.uint32).view(np.int32)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[i:j]), pa.array(count), pa.array(np.where(copy, count, 0)), pa.array(shas, pa.string()),
             pa.array(texts, pa.binary()), *lists],
            names=["id", "n_words", "n_copied", "sha", "words", "pos", "wa", "wb"])


_ROWS = ("id long, n_words long, n_copied long, sha string, words binary, pos array<int>, "
         "wa array<long>, wb array<int>")


def _located(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """``rows`` (part, kind, id, val, text) sorted by part and kind: copies (0), phrases (1), documents (2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now = None, None
        for batch in batches:
            parts, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            ids, vals, texts = np.asarray(batch.column(2)), np.asarray(batch.column(3)).view(U64), batch.column(4)
            key = parts.astype(np.int64) * 3 + kinds
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if parts[a] != part:
                    if now is not None:
                        yield from now.finish()
                    part, now = parts[a], _Part(window, phrase)
                if kinds[a] == 0:
                    now.copies.update(zip(ids[a:b].tolist(), vals[a:b].tolist()))
                elif kinds[a] == 1:
                    now.recurring.append(vals[a:b].copy())
                else:
                    now.ids.append(ids[a:b].copy())
                    now.texts.append(texts.slice(a, b - a))
        if now is not None:
            yield from now.finish()

    return rows.mapInArrow(run, _ROWS)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   phrase: int = PHRASE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per input row: key, n_words, ``removed`` (starts of the windows that cover words), n_removed and ``kept``
    (the words that are left, joined by a space; null where nothing or all is removed), kept_sha256."""
    if not 1 <= phrase <= window:
        raise ValueError("a phrase must fit into a window")
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("id"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("h"), "text")
    choice = stored(_choices(docs, window, phrase), "choices")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(n_partitions(spark), -(-size // part_bytes))
    # texts under one id, as where many ids are null, are spread
    part = F.pmod(F.xxhash64("id", "h"), F.lit(parts)).cast("int").alias("part")

    phrases = choice.filter("kind = 1").select("id", "h", F.col("a").alias("phrase"), F.col("b").alias("digest"))
    recurring = phrases.groupBy("phrase").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter(
        "lo < hi").select("phrase")
    wanted = phrases.select(part, "phrase").join(stored(recurring, "recurring"), "phrase").select(
        "part", "phrase").distinct()
    full = choice.filter(F.col("kind") == 0).filter(F.col("n_words") >= window)
    firsts = full.groupBy("a", "b").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = full.join(stored(firsts, "copies").select("a", "b", "first"), ["a", "b"]).filter(
        "id > first").select(part, "id", "a").distinct()
    none = F.lit(None).cast("string").alias("text")
    rows = (copies.select("part", F.lit(0).alias("kind"), "id", F.col("a").alias("val"), none)
            .union(wanted.select("part", F.lit(1), F.lit(0).cast("long"), "phrase", none))
            .union(docs.select(part, F.lit(2), "id", F.lit(0).cast("long"), "text")))
    found = stored(_located(rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind"),
                            window, phrase), "located").withColumn("uid", F.monotonically_increasing_id())

    wins = found.filter(F.size("pos") > 0).select("uid", "id", F.explode_outer(F.arrays_zip("pos", "wa", "wb")).alias("w"))
    wins = wins.select("uid", "id", "w.pos", "w.wa", "w.wb")
    first = wins.groupBy("wa", "wb").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter(
        "first < last").select("wa", "wb", "first")
    later = (wins.join(first, ["wa", "wb"]).filter("id > first")
             .groupBy(F.col("uid").alias("luid")).agg(F.sort_array(F.collect_set("pos")).alias("starts")))

    def cut(words: pa.Array, starts: pa.Array) -> pa.Array:
        kept = []
        for text, at in zip(words.to_pylist(), starts):
            w = text.split()
            step = np.zeros(len(w) + 1, dtype=np.int64)
            at = np.asarray(at.values)
            step[at] += 1
            np.subtract.at(step, at + window, 1)
            kept.append(b" ".join([x for x, c in zip(w, (np.cumsum(step)[:-1] == 0).tolist()) if c]).decode())
        return pa.array(kept, pa.string())

    cut_udf = F.arrow_udf(cut, "string")
    name = F.when(F.col("id") == F.lit(_NULL_ID), None).otherwise(F.col("id")).alias(key)
    touched = (found.filter(F.size("pos") > 0).select("uid", "id", "n_words", "words")
               .join(later, F.col("uid") == F.col("luid"), "left"))
    changed = touched.filter("starts is not null").withColumn("kept", cut_udf("words", "starts"))
    n_kept = F.when(F.col("kept") == "", 0).otherwise(F.size(F.split("kept", " ", -1))).cast("long")
    no_starts = F.array().cast("array<int>").alias("removed")
    null = F.lit(None).cast("string").alias("kept")
    return (found.filter(F.size("pos") == 0).select(
                name, "n_words", F.col("n_copied").alias("n_removed"), no_starts, null, F.col("sha").alias("kept_sha256"))
            .union(touched.filter("starts is null").select(
                name, "n_words", F.lit(0).cast("long"), no_starts, null, F.sha2("words", 256)))
            .union(changed.select(
                name, "n_words", F.col("n_words") - n_kept, "starts", "kept", F.sha2(F.col("kept").cast("binary"), 256))))
