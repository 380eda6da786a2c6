"""Positional document fingerprints by closed syncmers.

A k-mer is ``K`` consecutive code points of a text. Its inner substrings of ``S`` code points are
ordered by a hash; the k-mer is an anchor (a closed syncmer) if the smallest of them lies at its
first or last place. That depends on the k-mer alone, never on what stands around it, so equal
passages have equal anchors wherever they stand, and every run of ``K - S`` consecutive k-mers
holds one. The fingerprint of a text is all its anchors in text order, each as a 32-bit hash and
the distance from the anchor before it: base64 of five bytes an anchor, about 0.53 characters for
a character of text. Before and after the text stand ``K - LEAST`` marks that are no code
points, so texts from one code point on have anchors; a text with too few k-mers for an anchor
gives the one with the smallest hash. No anchor is left out at any length.

Two fingerprints are compared by position: anchors with the same hash (the n-th of one with the
n-th of the other where a hash repeats) are matched, the longest chain of matches that is
in order in both texts counts, and ``likeness`` is twice its length over the number of all
anchors: 1 for equal texts, 0 for texts without a common passage, about the share of the
text in common passages between.

``successor_edits`` compares every document with the next one in the order of the keys, and with
its own text whose second half gives way to the beginning of the next one. Only
boundaries are collected: distinct (key, text hash) pairs are numbered by a range partitioning,
every n-th one is a cut, at most two for each partition; a document goes to the block between two cuts,
where it meets its successor in one sorted pass; the first document of the next block is added
to each block. Whole texts move once. A pair that holds more rows than a block is dealt over
several blocks, each with the pair's successor.

Defined results: a null text is empty; the empty text has an empty fingerprint, and two empty ones have
likeness 1; a null key is smaller than all others; rows equal in key and text are one document
with one successor, the next different one, and each is a row of the result; rows with one key and
different texts are ordered by the 64-bit hash of the text; after the last document comes the first,
which is the document itself where there is only one; an empty table gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import n_partitions
from arcweave.operators.windows import sequence_number

K = 32
S = 8
LEAST = 16  # code points of text in a k-mer at the ends
CHUNK = 1 << 19  # k-mers hashed at once
OUT_BYTES = 4 << 20
_PAD = 0x110000  # above the last code point
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

Anchors = tuple[np.ndarray, np.ndarray]  # hashes (uint32) and places of the first code point (int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 1 << 64))


def _join(h: np.ndarray, part: int, times: int) -> np.ndarray:
    """Polynomial hashes of ``times`` neighbouring windows, from those of one window of ``part``."""
    m = len(h) - part * (times - 1)
    out = h[:m]
    for j in range(1, times):
        out = out * _power(part) + h[part * j:part * j + m]
    return out


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` neighbours from each place on."""
    low, have = v, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def _chunk(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the closed syncmers, hashes of all k-mers as a function of the numbers)."""
    one = _mix(codes.astype(np.uint64) + _U(_BASE))
    inner = _join(one, 1, s)
    order = _mix(inner)
    width = k - s + 1
    low = _smallest(order, width)
    at = np.flatnonzero((low == order[:len(low)]) | (low == order[width - 1:]))
    return at, inner


def _kmer_hash(inner: np.ndarray, at: np.ndarray, k: int, s: int) -> np.ndarray:
    out = inner[at]
    for j in range(s, k, s):
        out = out * _power(s) + inner[at + j]
    return (_mix(out) >> _U(32)).astype(np.uint32)


def anchors(text: str, k: int = K, s: int = S, least: int = LEAST) -> Anchors:
    """Closed syncmers of ``text`` in text order; places may be negative by the marks before the text."""
    if k % s or not 0 < 2 * least <= k or k - s > 255:
        raise ValueError("s must divide k, least be at most k / 2, and k - s at most 255")
    none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if not text:
        return none
    pad = np.full(k - least, _PAD, np.uint32)
    codes = np.concatenate([pad, np.frombuffer(text.encode("utf-32-le"), "<u4"), pad])
    n, hashes, places = len(codes) - k + 1, [], []
    for a in range(0, n, CHUNK):
        at, inner = _chunk(codes[a:a + CHUNK + k - 1], k, s)
        if n <= k - s and not len(at):
            every = _kmer_hash(inner, np.arange(n), k, s)
            at = np.array([int(every.argmin())])
        hashes.append(_kmer_hash(inner, at, k, s))
        places.append(at + (a - (k - least)))
    return np.concatenate(hashes), np.concatenate(places)


def pack(found: Anchors, k: int = K, least: int = LEAST) -> str:
    """The fingerprint string."""
    hashes, places = found
    raw = np.zeros((len(hashes), 5), np.uint8)
    raw[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    raw[:, 4] = np.diff(places, prepend=least - k)
    return base64.b64encode(raw.tobytes()).decode()


def unpack(fingerprint: str, k: int = K, least: int = LEAST) -> Anchors:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 5)
    hashes = np.ascontiguousarray(raw[:, :4]).view(">u4").reshape(-1).astype(np.uint32)
    return hashes, np.cumsum(raw[:, 4].astype(np.int64)) + (least - k)


def _labelled(hashes: np.ndarray) -> np.ndarray:
    """Each hash with the number of equal ones before it."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    nth = np.arange(len(ranked)) - np.repeat(first, np.diff(np.r_[first, len(ranked)]))
    out = np.empty(len(hashes), np.uint64)
    out[order] = (ranked.astype(np.uint64) << _U(32)) | nth.astype(np.uint64)
    return out


def _chain(x: np.ndarray) -> int:
    """Length of the longest increasing subsequence of distinct numbers."""
    if len(x) < 2 or bool((x[1:] > x[:-1]).all()):
        return len(x)
    ends: list[int] = []
    for v in x.tolist():
        i = bisect_left(ends, v)
        ends[i:i + 1] = [v]
    return len(ends)


def likeness(a: Anchors, b: Anchors) -> float:
    """Share of anchors in the longest common chain, 0 to 1."""
    n = len(a[0]) + len(b[0])
    if not n:
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if np.array_equal(a[0], b[0]):
        return 1.0
    _, i, j = np.intersect1d(_labelled(a[0]), _labelled(b[0]), assume_unique=True, return_indices=True)
    return 2.0 * _chain(j[np.argsort(i)]) / n


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars (code points) and fingerprint of every row; one pass without a shuffle."""
    src = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([pack(anchors(t)) for t in texts], pa.string())], names=[key, "n_chars", "fingerprint"])

    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, n_chars long, fingerprint string")


def anchor_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hash, place: one row for each anchor, the join table of positional matching."""
    src = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, places = anchors(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([i] * len(hashes), pa.int64())),
                    pa.array(hashes.astype(np.int64)), pa.array(places)], names=[key, "hash", "place"])

    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, hash long, place long")


# ---------------------------------------------------------------- documents and their successors


def _cuts(docs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(cuts, wanted): the first pair of each block, and for each block the pair that follows its last one.

    At most two rows a partition each: every n-th pair, and pairs of more rows than a block.
    """
    pairs = docs.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"))
    numbered = sequence_number(pairs, ["id", "h"], "seq", parts)
    size = numbered.agg(F.greatest(F.ceil(F.sum("n") / parts), F.lit(1)).alias("size"), F.max("seq").alias("last"))
    cut = (numbered.crossJoin(F.broadcast(size))  # one row
           .filter(((F.col("seq") - 1) % F.col("size") == 0) | (F.col("n") > F.col("size")))
           .select("id", "h", "seq", "last", F.ceil(F.col("n") / F.col("size")).cast("int").alias("spread")))
    listed = cut.agg(F.array_sort(F.collect_list(F.struct("seq", "id", "h", "last", "spread"))).alias("cuts"))
    # block of a cut: the number of blocks before it
    cuts = listed.withColumn("base", F.aggregate(
        F.col("cuts"), F.array(F.lit(0)),
        lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["spread"])))).checkpoint()
    each = cuts.select("cuts", "base", F.posexplode("cuts").alias("j", "cut"))
    after = F.when(F.col("j") + 1 < F.size("cuts"), F.element_at("cuts", F.col("j") + 2)["seq"]).otherwise(1)
    blocks = each.select(
        F.explode(F.sequence(F.lit(0), F.col("cut.spread") - 1)).alias("sub"),
        F.element_at("base", F.col("j") + 1).alias("first"), after.alias("after"),
        F.when(F.col("cut.seq") == F.col("cut.last"), 1).otherwise(F.col("cut.seq") + 1).alias("follows"))
    wanted = blocks.select(
        (F.col("first") + F.col("sub")).alias("block"),
        F.when(F.col("sub") == 0, F.col("after")).otherwise(F.col("follows")).cast("long").alias("seq"))
    wanted = F.broadcast(wanted).join(numbered, "seq").select("block", F.col("id").alias("wid"), F.col("h").alias("wh"))
    return cuts, wanted.checkpoint()


def _in_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """(block, mark, id, h, text) sorted in each partition; after the rows of a block comes the document that
    follows its last one (mark 1)."""
    cuts, wanted = _cuts(docs, parts)
    bits = F.sequence(F.ceil(F.log2(F.size("cuts") + 1)).cast("int"), F.lit(0), F.lit(-1))
    me = F.struct("id", "h")

    def pair(i):
        c = F.element_at("cuts", i)
        return F.struct(c["id"].alias("id"), c["h"].alias("h"))

    # binary search: the last cut that is not after the row
    def step(at, bit):
        to = at + F.pow(F.lit(2.0), bit).cast("int")
        return F.when((to <= F.size("cuts")) & (pair(F.least(to, F.size("cuts"))) <= me), to).otherwise(at)

    found = docs.crossJoin(F.broadcast(cuts)).withColumn("at", F.aggregate(bits, F.lit(0), step))  # one row
    spread = F.element_at("cuts", F.col("at"))["spread"]
    sub = F.when((spread > 1) & (pair(F.col("at")) == me),
                 F.pmod(F.monotonically_increasing_id(), spread).cast("int")).otherwise(0)
    rows = found.select((F.element_at("base", F.col("at")) + sub).alias("block"), F.lit(0).alias("mark"),
                        "id", "h", "text")
    marks = (docs.join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh")))
             .groupBy("block").agg(F.first("id").alias("id"), F.first("h").alias("h"), F.first("text").alias("text"))
             .select("block", F.lit(1).alias("mark"), "id", "h", "text"))
    return (rows.unionByName(marks).repartition(parts, "block")
            .sortWithinPartitions("block", "mark", "id", "h"))


class _Result:
    """Rows of the result, given out in batches of bounded size."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.rows, self.size = names, kinds, [], 0

    def add(self, row: tuple, times: int) -> Iterator[pa.RecordBatch]:
        cost = 64 + len(row[3]) + len(row[4])
        while times:
            take = min(times, max(1, (OUT_BYTES - self.size) // cost))
            self.rows.extend([row] * take)
            self.size += take * cost
            times -= take
            if self.size >= OUT_BYTES:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*self.rows), self.kinds)], names=self.names)
        self.rows, self.size = [], 0


def edited(text: str, following: str) -> str:
    """``text`` with its second half (rounded down) replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def successor_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("h"), "text")
    parts = n_partitions(df.sparkSession)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = None, None  # held: block, key, text, anchors, rows
        for batch in batches:
            out = out or _Result(names, [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(),
                                         pa.string(), pa.float64(), pa.float64()])
            columns = [batch.column(i) for i in (0, 1, 2, 4)]
            for i in range(batch.num_rows):
                block, mark, ident, t = (c[i].as_py() for c in columns)
                if held and not mark and held[0] == block and held[1] == ident and held[2] == t:
                    held[4] += 1
                    continue
                own = anchors(t)
                if held and held[0] == block:
                    changed = edited(held[2], t)
                    new = anchors(changed)
                    yield from out.add((
                        held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), pack(held[3]), pack(new),
                        likeness(held[3], new), likeness(held[3], own)), held[4])
                held = None if mark else [block, ident, t, own, 1]
        if out:
            yield from out.flush()

    kind = docs.schema["id"].dataType.simpleString()
    return _in_blocks(docs, parts).mapInArrow(
        run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
