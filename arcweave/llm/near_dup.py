"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of words. Each of ``SKETCHES`` hash functions picks the ``PICKS``
smallest of its three-word k-mers, each labelled with how often it occurred before, and keeps
them in text order; two documents that agree on a sketch are candidates. Agreement depends on
common k-mers and on their order, so it follows edit similarity. Candidates are linked if a
banded alignment finds at most 20 % of the longer one's words as edits. Classes are the connected
components of the links.

Texts with equal words are one text first (an aggregation over a 128-bit digest). The texts of a
bucket are first aligned with its centre only, chosen by one of two orders of all texts, and the
classes of all links so far are found. A bucket whose members without the centre are one class is
done: a large group of copies costs one alignment per text and order. Otherwise all its members go
on, linked to the centre or not, and only pairs of two classes are looked at: all of them in a bucket
of up to ``SMALL`` members. The members of larger ones meet instead in buckets of their rarest words, one
for each word whatever bucket they come from; two near texts always share one, so texts that share a
passage and nothing else come apart. What is still large gets ``GROWTH`` times as many centres each turn
until one class is left or all have been compared. So two near texts that agree on any sketch always end
in one class, and no bucket is cut off. Two texts that have some of their ``HEAD`` rarest words in common
are paired in the bucket of the rarest common one and nowhere else; others that share large buckets, in the first
of these (texts with a common passage share many). There a word counts only if it comes so early in both lists that
enough words are left for the common ones. A pair is formed only if the parities of its word counts by hash bin differ in at most two bins for each edit allowed, and
aligned only if the counts by bin can be made good by these edits; neither is ever false for near texts.

For k-mer sets with a Jaccard similarity J a sketch agrees with a chance of about J^2. Scattered edits
of 20 % of the words, the most that is accepted, leave J = 0.34: 40 sketches miss 0.7 % of such pairs.
With 15 % (J = 0.44) fewer than 0.02 % are missed, with 10 % (J = 0.57) fewer than one in 10^6. This
holds for long texts. Short ones have few k-mers, so texts of ``LEAST`` to ``SHORT`` words are also put into
a bucket for each of their rarest words, of which near ones share one: between them no pair is missed.

Defined results: null, blank and equal texts are copies of each other; texts of under five words
have no sketch and are only copies or unique; a null id is smaller than all others; rows are
told apart by id and words, so different texts under a null or repeated id are documents of their
own; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import fresh, keyed, stored, words
from arcweave.llm.components import components, extend
from arcweave.llm.wordhash import U64, Words, chunks, digests, mix, signed, split_words, splitmix, text_buffer

KMER = 3
SKETCHES = 40
PICKS = 2
LEAST = 5  # words of a text that is more than a copy or unique
CANDIDATES = 12  # k-mers of a document that are sorted to find the smallest (more if they are too few)
EDIT_PERCENT = 20
ORDERS = 2
SHORT = 30  # words up to which a text also meets others by its rarest words
PARITY = 4  # longs of parities of word counts
SMALL = 32  # members up to which a bucket is compared in full
GROWTH = 32  # by which the centres of a larger bucket grow each turn
HEAD = 8  # rarest words of a text that tell where it is paired
BINS = 128
BAND = 512  # width that a first alignment has at least, as far as the limit allows
_NULL_ID = -(1 << 63)
_MAX = U64(0xFFFFFFFFFFFFFFFF)


def order_minhash(w: Words, h: np.ndarray, k: int = KMER, sketches: int = SKETCHES,
                  picks: int = PICKS) -> tuple[np.ndarray, np.ndarray]:
    """(documents with a k-mer and ``LEAST`` words, their sketches as rows)."""
    g = w.windows(h, k)
    count = np.maximum(np.diff(w.first) - k + 1, 0)
    count[np.diff(w.first) < LEAST] = 0
    docs = np.flatnonzero(count)
    if not len(docs):
        return docs, np.zeros((0, sketches), dtype=U64)
    count = count[docs]
    edge = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(docs)), count)
    g = g[np.arange(edge[-1]) - edge[doc] + w.first[docs][doc]]
    # occurrence label: rank among the equal k-mers of the document, in text order
    own = g + mix(doc.astype(U64))
    order = np.argsort(own, kind="stable")
    s = own[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))
    seen = np.empty(len(s), dtype=U64)
    seen[order] = (at - np.maximum.accumulate(np.where(head, at, 0))).astype(U64)
    label = mix(g + seen * U64(0x9E3779B97F4A7C15)) | U64(1)
    n, numbers = len(docs), np.arange(len(docs))
    # the smallest values of a document lie below this with a good chance; else all its k-mers are looked at
    bound = np.where(count > CANDIDATES, np.float64(2 ** 64) * CANDIDATES / np.maximum(count, CANDIDATES + 1), 0)
    bound = np.repeat(np.where(count > CANDIDATES, bound.astype(U64), _MAX), count)
    out = np.empty((n, sketches), dtype=U64)
    padded = np.concatenate([g, np.zeros(1, dtype=U64)])
    for j, a in enumerate(splitmix(31, sketches) | U64(1)):
        v = label * a
        v ^= v >> U64(32)
        at = np.flatnonzero(v <= bound)
        per = np.bincount(doc[at], minlength=n)
        few = np.flatnonzero((per < picks) & (per < count))
        if len(few):
            at = np.concatenate([at[~np.isin(doc[at], few)], *[np.arange(edge[d], edge[d + 1]) for d in few]])
        at = at[np.argsort((doc[at].astype(U64) << U64(40)) | (v[at] >> U64(24)), kind="stable")]
        first = np.searchsorted(doc[at], np.arange(n + 1))
        found = np.full((picks, n), edge[-1], dtype=np.int64)
        for r in range(picks):
            live = numbers[first[:-1] + r < first[1:]]
            found[r, live] = at[first[live] + r]
        found.sort(axis=0)  # text order
        value = np.full(n, U64(j + 1))
        for r in range(picks):
            value = mix(value * U64(0xD6E8FEB86659FD93) + padded[found[r]])
        out[:, j] = value
    return docs, out


def _parities(w: Words, h: np.ndarray, n: int) -> np.ndarray:
    """Per document ``PARITY`` longs: whether a word occurs in each of their bins an odd number of times."""
    bits = 64 * PARITY
    odd = np.bincount(w.doc_of_word() * bits + (h % U64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(U64)


def _numbered_words(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of all words of short texts; equal words of a text are numbered."""
    size = np.diff(w.first)
    short = (size >= LEAST) & (size <= SHORT)
    doc = w.doc_of_word()
    at = np.flatnonzero(short[doc]) if len(doc) else doc
    doc, own = doc[at], h[at]
    order = np.lexsort((own, doc))
    same = np.r_[False, (doc[order][1:] == doc[order][:-1]) & (own[order][1:] == own[order][:-1])] if len(at) else order
    place = np.arange(len(order))
    nth = np.empty(len(order), dtype=U64)
    nth[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(U64) if len(order) else nth
    return doc, mix(own + nth * U64(0x9E3779B97F4A7C15))


def _lists(per: np.ndarray, values: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), signed(values))


def _sketched(df: DataFrame) -> DataFrame:
    """id, h, n_words, digests a and b, sketches, parity, and the tokens of short texts; one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j in chunks(offsets):
                w = split_words(data, offsets[i:j + 1])
                h = w.hashes(1)
                d1, d2 = digests(w, h, w.hashes(2))
                docs, values = order_minhash(w, h)
                per = np.zeros(j - i, dtype=np.int32)
                per[docs] = values.shape[1]
                doc, tokens = _numbered_words(w, h)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(w.first)),
                     signed(d1), signed(d2), _lists(per, values.ravel()),
                     _lists(np.full(j - i, PARITY), _parities(w, h, j - i).ravel()),
                     _lists(np.bincount(doc, minlength=j - i), tokens)],
                    names=["id", "h", "n_words", "a", "b", "sketches", "parity", "tokens"])

    return df.mapInArrow(run, "id long, h long, n_words long, a long, b long, sketches array<long>, "
                              "parity array<long>, tokens array<long>")


def band_distance(a: Sequence, b: Sequence, band: int) -> int | None:
    """Edit distance of two sequences if it is at most ``band``, computed on 2 * band + 1 diagonals.

    Bit-parallel: one column of the band is a pair of bit vectors of vertical differences, and the
    window moves down by one row with each column.
    """
    m, n = len(a), len(b)
    if abs(m - n) > band:
        return None
    if not m or not n:
        return max(m, n)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    width = 2 * band + 1
    mask = (1 << width) - 1
    top = width - 1
    up = ((1 << (band + 1)) - 1) << band
    down = 0
    steps = max(m - band, 0)  # columns in which the lower edge of the band is followed
    distance = min(band, m)
    give_up = 2 * band + n - m  # from the lower edge at most that much can be made good
    for j, x in enumerate(b):
        eq = where.get(x, 0)
        eq = (eq >> (j - band) if j >= band else eq << (band - j)) & mask
        same = ((((eq & up) + up) ^ up) | eq | down) & mask
        plus = down | (~(same | up) & mask)
        minus = same & up
        if j < steps:
            distance += 1 - (same >> top & 1)
            if distance > give_up:
                return None
        else:
            at = m - 1 - j + band
            distance += (plus >> at & 1) - (minus >> at & 1)
        same >>= 1
        up = minus | (~(same | plus) & mask)
        down = same & plus
    return distance if distance <= band else None


def edit_distance_within(a: Sequence, b: Sequence, limit: int) -> int | None:
    """Edit distance if at most ``limit``: equal ends are cut off, then the band doubles until it suffices.

    A column costs about the same for any band of a few hundred diagonals, so it starts that wide.
    """
    i, j, n = 0, 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i:len(a) - j], b[i:len(b) - j]
    if abs(len(a) - len(b)) > limit:
        return None
    band = min(max(BAND, abs(len(a) - len(b))), limit)
    while True:
        found = band_distance(a, b, band)
        if found is not None or band >= limit:
            return found
        band = min(2 * band, limit)


def _bags(texts: pa.Array) -> pa.Array:
    """How many words of a text fall into each of ``BINS`` bins by hash, one byte a bin (at most 255)."""
    data, offsets = text_buffer(texts)
    out = []
    for i, j in chunks(offsets):
        w = split_words(data, offsets[i:j + 1])
        at = w.doc_of_word() * BINS + (w.hashes(1) % U64(BINS)).astype(np.int64)
        count = np.bincount(at, minlength=(j - i) * BINS).reshape(-1, BINS)
        out += [x.tobytes() for x in np.minimum(count, 255).astype(np.uint8)]
    return pa.array(out, pa.binary())


def _possible(left: pa.Array, right: pa.Array, limit: pa.Array) -> pa.Array:
    """Whether no more words are missing on either side than ``limit`` edits can make good (never false for near ones)."""
    if not len(left):
        return pa.array([], pa.bool_())
    x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(-1, BINS).astype(np.int16) for c in (left, right))
    d, most = x - y, np.asarray(limit)
    return pa.array((np.maximum(d, 0).sum(axis=1) <= most) & (np.maximum(-d, 0).sum(axis=1) <= most))


def _aligned(left: pa.Array, right: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(left.to_pylist(), right.to_pylist()):
        x, y = x.encode().split(), y.encode().split()
        limit = max(len(x), len(y)) * EDIT_PERCENT // 100
        out.append(edit_distance_within(x, y, limit) is not None)
    return pa.array(out, pa.bool_())


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ok) for pairs (a, b, limit); those whose bags of words exclude it are not aligned."""
    side = lambda key, *cols: texts.select(F.col("rep").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in cols])
    possible = F.arrow_udf(_possible, "boolean")
    bags = stored(pairs.join(side("a", "bag"), "a").join(side("b", "bag"), "b")
                  .select("a", "b", possible("a_bag", "b_bag", "limit").alias("possible")), "bags")
    ok = F.arrow_udf(_aligned, "boolean")
    some = bags.filter("possible").join(side("a", "text"), "a").join(side("b", "text"), "b").select(
        "a", "b", ok("a_text", "b_text").alias("ok"))
    return some.union(bags.filter("not possible").select("a", "b", F.lit(False)))


def _rarest(tokens: DataFrame) -> DataFrame:
    """(rep, rare): the rarest fifth of a text's tokens, and one more, of a table (rep, token) of all of them.

    Two texts of which one becomes the other by editing at most a fifth of the longer one's words have
    four fifths of its words in common, so in any one order of all words these lists share one. Lists
    start with the rarest token, and all are in the same order.
    """
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # a list is bounded by its own row's text
    lists = tokens.join(common, "token").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("o"))
    size = F.floor(F.size("o") * F.lit(EDIT_PERCENT) / F.lit(100)).cast("int") + 1
    return lists.select("rep", F.transform(F.slice("o", F.lit(1), size), lambda o: o["token"]).alias("rare"))


def _rare_words(texts: DataFrame) -> DataFrame:
    """(rep, rare): the rarest words of the texts (rep, text); equal words of a text are numbered."""
    return _rarest(stored(texts.select("rep", F.explode(words(F.col("text"))).alias("w"))
                          .groupBy("rep", "w").agg(F.count(F.lit(1)).cast("int").alias("c"))
                          .select("rep", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("c"), "w")
                          .select("rep", F.xxhash64("w", "c").alias("token")), "tokens"))


def _buckets(unique: DataFrame) -> DataFrame:
    """(bucket, rep): one bucket for each sketch, and for each of the rarest words of a short text."""
    sketches = unique.select("rep", F.posexplode("sketches").alias("j", "s")).select(
        F.xxhash64("s", "j").alias("bucket"), "rep")
    tokens = unique.select("rep", F.explode("tokens").alias("token"))
    return sketches.union(_rarest(tokens).select(F.explode("rare").alias("token"), "rep")
                          .select(F.xxhash64("token", F.lit(-1)).alias("bucket"), "rep"))


def _parity_distance() -> Column:
    """Bins in which the parities of two texts differ: at most two for each edit."""
    bits = [F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("px")[i])) for i in range(PARITY)]
    return reduce(lambda x, y: x + y, bits)


def _can_be_rarest(place: str, n_words: str, common: Column) -> Column:
    """Whether a word at this place of a text's words, rarest first, can be the rarest of ``common`` or more common words.

    The words before it are not common then. A bucket that is not one of a word has no place.
    """
    return F.coalesce(F.col(place) <= F.col(n_words) - common, F.lit(True))


def _paired_here() -> Column:
    """Whether two members are paired in this bucket and not in another that they share.

    It is that of the rarest word that both heads have; if they have none in common, the first of the large buckets
    that they share (of the rarest word), and any small one.
    """
    first = lambda x, y: F.get(F.array_intersect(x, y), F.lit(0)) == F.col("bucket")
    return (F.when(F.arrays_overlap("head", "hx"), first("head", "hx"))
            .when(F.col("n") > SMALL, F.coalesce(first("large", "gx"), F.lit(True))).otherwise(F.lit(True)))


def find_links(docs: DataFrame, unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, label) between the texts of ``unique`` (rep, id, h, n_words, sketches, parity, tokens).

    Links (a, b), a < b, are verified; with others they join all texts into one class that agree on a bucket and are
    near, directly or through others. ``label`` (node, label) names the class of each linked text.
    """
    todo = stored(_buckets(unique), "buckets").withColumn("place", F.lit(None).cast("int"))
    none = F.lit(None).cast("array<long>")
    facts = unique.select("rep", "n_words", "parity", none.alias("head"))
    shared = None  # (rep, large): the large buckets of a text from the second turn on, in the order of their words
    texts, label, verdicts, turn = None, None, [], 0
    while True:
        # counting members and bringing them together share one shuffle of two or three numbers a member
        # (the filter drops no row; it gives both sides the same plan)
        dealt = todo.filter("bucket is not null and rep is not null").repartition("bucket")
        dealt = dealt if label is not None else dealt.withColumn("label", F.col("rep"))
        # one of a few orders of all texts in a turn, so that a class has few different centres
        rank = F.xxhash64("rep", F.pmod("bucket", F.lit(ORDERS)), F.lit(turn))
        sizes = (dealt.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "rep")).alias("c"), F.count(F.lit(1)).alias("n"),
                                             F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .filter("lo <> hi").select("bucket", F.col("c.rep").alias("first"), "n"))  # several classes
        # in the first turn one centre; later about GROWTH ** turn in a large bucket and all members in a small one
        centre = F.col("rep") == F.col("first")
        if turn:
            part = rank.cast("double") / F.lit(2.0 ** 64) + 0.5
            centre = centre | (F.col("n") <= SMALL) | (part < F.lit(float(GROWTH) ** turn - 1) / F.col("n"))
        met = stored(dealt.join(sizes, "bucket").select("bucket", "rep", "place", "n", "label", centre.alias("centre"))
                     .join(facts, "rep"), "met")
        if met.isEmpty():
            break
        if turn and shared is None:
            # later turns keep these, as a pair that is not formed in a bucket is left to an earlier one
            shared = stored(met.filter(F.col("n") > SMALL).groupBy("rep").agg(
                F.sort_array(F.collect_list(F.struct("place", "bucket"))).alias("o"))
                .select("rep", F.transform("o", lambda o: o["bucket"]).alias("large")), "shared")
        member = met.withColumn("large", none)
        if turn:
            member = member.filter(F.col("n") <= SMALL).unionByName(
                met.filter(F.col("n") > SMALL).join(shared, "rep", "left"))
        if texts is None:  # later turns only have texts of the first
            need = unique.join(met.select("rep").distinct(), "rep").select("rep", "id", "h")
            texts = keyed(docs.join(need, ["id", "h"]).groupBy("rep").agg(F.first("text").alias("text"))
                          .withColumn("bag", F.arrow_udf(_bags, "binary")("text")), "texts", "rep")
        x = member.filter("centre").select(F.col("bucket").alias("at"), F.col("rep").alias("x"), F.col("n_words").alias("nx"),
                                           F.col("label").alias("lx"), F.col("parity").alias("px"), F.col("head").alias("hx"),
                                           F.col("large").alias("gx"), F.col("place").alias("ox"))
        longer, shorter = F.greatest("n_words", "nx"), F.least("n_words", "nx")
        limit = F.floor(longer * EDIT_PERCENT / 100).cast("long")
        new = (member.join(x, (F.col("bucket") == F.col("at")) & (F.col("label") != F.col("lx")) & (longer - shorter <= limit)
                        & (~F.col("centre") | (F.col("rep") > F.col("x"))) & (_parity_distance() <= 2 * limit)
                        & _can_be_rarest("place", "n_words", longer - limit) & _can_be_rarest("ox", "nx", longer - limit)
                        & _paired_here())
               .select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b"), limit.alias("limit")).distinct())
        if verdicts:
            new = new.join(reduce(DataFrame.union, verdicts).select("a", "b"), ["a", "b"], "left_anti")
        verdicts.append(stored(_verify(new, texts), "verdicts"))
        linked = verdicts[-1].filter("ok").select("a", "b")
        if label is None:
            label = stored(components(linked, "a", "b"), "label")
        elif not linked.isEmpty():
            label = stored(extend(label, linked, "a", "b"), "label")
        # a centre has met all others; the rest of a bucket is done when it is one class
        rest = met.filter("not centre").select("bucket", "rep", "place", "n").join(
            label, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "place", "n", F.coalesce("label", "rep").alias("label"))
        several = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        rest = stored(rest.join(several.select("bucket"), "bucket").select("bucket", "rep", "place", "label", "n"), "rest")
        todo = rest.select("bucket", "rep", "place", "label")
        if turn == 0:
            # members of large buckets can be near only if they share one of their rarest words
            large = stored(rest.filter(F.col("n") > SMALL).select("rep", "label").distinct(), "large")
            rare = _rare_words(texts.join(large.select("rep"), "rep").select("rep", "text"))
            rare = stored(rare.select("rep", F.transform("rare", lambda t: F.xxhash64(t, F.lit(-2))).alias("rare")), "rare")
            todo = stored(rest.filter(F.col("n") <= SMALL).select("bucket", "rep", "place", "label").unionByName(
                large.join(rare, "rep").select(F.posexplode("rare").alias("place", "bucket"), "rep", "label")), "refined")
            facts = facts.drop("head").join(rare.select("rep", F.slice("rare", 1, HEAD).alias("head")), "rep", "left")
        turn += 1
    if not verdicts:
        empty = met.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        return empty, empty.withColumnsRenamed({"a": "node", "b": "label"})
    return reduce(DataFrame.union, verdicts).filter("ok").select("a", "b"), label


def _classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per input row: id, h (hash of the text), a and b (digests of its words), class_id, n_links and kept."""
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("id"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("h"), "text")
    rows = stored(_sketched(docs), "sketches")
    # texts are numbered, so that no two of them are ever one node
    unique = stored(rows.groupBy("a", "b").agg(
        F.min(F.struct("id", "h")).alias("first"), F.first("n_words").alias("n_words"), F.first("sketches").alias("sketches"),
        F.first("parity").alias("parity"), F.first("tokens").alias("tokens"))
        .select("a", "b", "first.*", "n_words", "sketches", "parity", "tokens")
        .sortWithinPartitions("a", "b").withColumn("rep", F.monotonically_increasing_id()), "unique")
    links, label = find_links(docs, unique)
    ends = links.select(F.col("a").alias("e")).union(links.select("b")).groupBy("e").agg(
        F.count(F.lit(1)).alias("n_links"))
    texts = stored(unique.select("rep", "a", "b", "id").join(label, F.col("rep") == F.col("node"), "left")
                   .join(ends, F.col("rep") == F.col("e"), "left")
                   .select("a", "b", "id", F.col("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "texts")
    # texts without a link are their own class and need no aggregation
    first = (texts.filter("label is not null").groupBy("label").agg(F.min(F.struct("id", "a", "b")).alias("f"))
             .withColumnRenamed("label", "l"))
    own = F.struct("id", "a", "b")
    facts = stored(texts.join(first, F.col("label") == F.col("l"), "left")
                   .select("a", "b", F.coalesce("f", own).alias("f"), "n_links"), "classes")
    return rows.select("id", "h", "a", "b").join(facts, ["a", "b"]).select(
        "id", "h", "a", "b", F.col("f.id").alias("class_id"), "n_links", (own == F.col("f")).alias("kept"))


def _real(c: str) -> Column:
    return F.when(F.col(c) == F.lit(_NULL_ID), None).otherwise(F.col(c))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: key, ``class_id`` (the smallest id of its class), n_links (different texts it is linked
    to directly) and ``kept`` (true for the smallest id of the class and its first text by digest)."""
    return _classes(df, key, text).select(_real("id").alias(key), _real("class_id").alias("class_id"), "n_links", "kept")


def one_per_class(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each class, with all its columns: of the kept id and words the text with the smallest hash."""
    k, h, n = fresh(df, "kept_key", "kept_hash", "kept_rows")
    rows = _classes(df, key, text).filter("kept").groupBy("id", "a", "b", "h").agg(F.count(F.lit(1)).alias("n"))
    keep = stored(rows.groupBy("id", "a", "b").agg(F.min(F.struct("h", "n")).alias("m"))
                  .select(_real("id").alias(k), F.col("m.h").alias(h), F.col("m.n").alias(n)), "kept")
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    pick = lambda ids: df.join(ids.drop(n), F.col(key).eqNullSafe(F.col(k)) & (own == F.col(h)), "left_semi")
    single, several = keep.filter(F.col(n) == 1), stored(keep.filter(F.col(n) > 1), "repeated")
    # rows that are there several times are few or none; only they are grouped
    repeated = pick(several).withColumn(h, own).dropDuplicates([key, h]).drop(h)
    return pick(single).unionByName(repeated)
