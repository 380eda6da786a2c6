"""Token-id files: adaptive context mixing and a range coder, in independently reset blocks.

Order 0 gives each id a share for how often it came in the block, up to the last update (after 16, 32,
64, ... ids, later every 512), and ids that did not come yet shares that fall with their number, all
together about as much as Good and Turing's estimate from the ids that came once. Order 1 and order 2 each
predict one id, the last that followed the previous one or two ids. The distribution of an id is a mixture
of the three orders: the share of a prediction follows how often predictions of that order and confidence
came true so far in the block (the mixing weights adapt), and predictions that agree have one share
together. An id is coded in the share of the highest order that has it, by a range coder with 48-bit
state and 16-bit output whose carries are added at the end of the block.

Every block starts from an empty model, carries its length and a CRC-32 of its ids, and can be
read alone. Blocks are coded in lock-step: step t handles the t-th id of up to ``LANES`` blocks
with numpy. All arithmetic is on integers, or on doubles where a quotient is exact, so encoder and
decoder agree on every machine.

File format: frames, each followed by a newline. A frame is ``CMX2``, then little-endian 64-bit
numbers: bytes after this header, partition number, frame number, documents, ids, blocks; then per
document its key (64 bits), a null flag (8 bits) and its number of ids (64 bits); then per block
its ids, bytes and CRC-32 (32 bits each); then the blocks.

``write_ids`` sorts the documents by a range partitioning on the key, tokenises each partition as
a stream and lets the text writer put the frames (bytes that it does not look at) into one file
per partition. ``read_ids`` reads the files back. Positions come from the sum of ids per file, a
table with one row per file.

Defined results: a null text is empty and has only the end id; a null key sorts first; rows with
one key are neighbours in any order; an empty table writes no frame and reads as no rows; a
damaged block raises an error; further columns are not looked at.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.common import n_partitions, stored

END_ID = 1
LANES = 2048
BLOCK = 4096            # ids of a block; fewer where a frame has not enough for FEW_LANES blocks
FEW_LANES = 256
FRAME_IDS = LANES * BLOCK
PART_BYTES = 16 << 20
UPDATE = 512            # ids between updates of order 0, at most
MAX_UNIT = 1024         # share of one place of the history
MAX_ODDS = 112          # of a prediction, in sixteenths: totals stay below 2^27 and products below 2^31
SLOTS = 11              # bits of a block's slot number in the prediction tables
MAGIC = b"CMX2"
HEAD = struct.Struct("<4s6q")


def _weights() -> tuple[np.ndarray, np.ndarray]:
    """Share of each id before it was seen, by rank as in a frequency-ordered vocabulary, and where it starts."""
    share = np.maximum((1 << 14) // (np.arange(1 << 16) + 64), 1)
    return share.astype(np.int32), np.concatenate([[0], np.cumsum(share)]).astype(np.int32)


NEW, NEW_FROM = _weights()
NEW_ID = np.repeat(np.arange(1 << 16, dtype=np.int32), NEW)  # the id at every place of the shares
ALL_NEW = int(NEW_FROM[-1])
#: Odds in sixteenths of a prediction by its rate of success in 1,024 steps.
ODDS = np.minimum((np.arange(1024) << 4) // (1025 - np.arange(1024)), MAX_ODDS).astype(np.int32)


class _History:
    """Order 0: the ids of every lane up to the last of ``UPDATES``, sorted; an id's share is how often it is there.

    Ids not seen yet share ``ALL_NEW``; a sorted place has a share chosen per lane, by how many of its ids came once.
    """

    def __init__(self, ids: np.ndarray):  # (lanes, steps so far)
        lanes, self.n = ids.shape
        self.edge = np.arange(lanes, dtype=np.int64) * self.n  # first place of a lane
        rows = np.sort(ids.astype(np.uint16), axis=1, kind="stable")
        head = np.ones((lanes, self.n), dtype=bool)
        head[:, 1:] = rows[:, 1:] != rows[:, :-1]
        start = np.flatnonzero(head.ravel())
        # per lane and id: its number, first place in the lane, and how often it came
        self.ids = rows.ravel()[start]
        self.count = np.diff(start, append=lanes * self.n)
        lane = start // max(self.n, 1)
        self.first = start - lane * self.n
        self.keys = (lane.astype(np.uint32) << np.uint32(16)) | self.ids
        once = np.bincount(lane[self.count == 1], minlength=lanes)
        self.unit = np.minimum(ALL_NEW // np.maximum(once, 1), MAX_UNIT).astype(np.int32)
        self.total = ALL_NEW + self.unit * self.n

    def places(self) -> np.ndarray:
        """First place, count and id (above bits 32, 16 and 0) for every place."""
        return np.repeat((self.first << 32) | (self.count << 16) | self.ids, self.count)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the ids ``x`` (lanes, steps) among all places."""
        start, size = NEW_FROM[x], NEW[x]
        if not self.n:
            return start, size
        lane = np.arange(len(x), dtype=np.uint32) << np.uint32(16)
        own = (lane[:, None] | x.astype(np.uint32)).ravel()
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        seen = np.flatnonzero(self.keys.take(at) == own)
        at, unit = at[seen], self.unit.take(seen // x.shape[1])
        start.reshape(-1)[seen] = ALL_NEW + self.first.take(at) * unit
        size.reshape(-1)[seen] = self.count.take(at) * unit
        return start, size


class _Model:
    """Orders 1 and 2 of all lanes: predictions, and how often those of a confidence came true.

    Arrays hold order 1 of all lanes, then order 2.
    """

    def __init__(self, lanes: int):
        self.lanes, self.both = lanes, np.arange(2 * lanes, dtype=np.int64)
        # predicted id, and above it the confidence
        self.seen = np.zeros(2 * lanes << SLOTS, dtype=np.int32)
        self.right = np.full(2 * lanes * 8, 1 << 14, dtype=np.int32)
        self.key = np.zeros(2 * lanes, dtype=np.int64)
        self.one = np.zeros(lanes, dtype=np.int64)

    def predictions(self, own: np.ndarray):
        """(ids, shares of order 1, of order 2) beside the shares ``own`` (twice) of order 0."""
        slot = self.key ^ (self.key >> 15)
        slot &= (1 << SLOTS) - 1
        slot *= 2 * self.lanes
        slot += self.both
        packed = self.seen.take(slot)
        sure = packed >> 16
        guess = packed & 65535
        at = sure * (2 * self.lanes) + self.both
        rate = self.right.take(at)
        share = ODDS.take(rate >> 6)
        share *= own
        share >>= 4
        share[sure == 0] = 0
        self.found = slot, guess, sure, at, rate
        n = self.lanes
        same = share[:n] * (guess[:n] == guess[n:])  # orders that agree have one share together
        return guess, share[:n] - same, share[n:] + same

    def learn(self, x: np.ndarray) -> None:
        slot, guess, sure, at, rate = self.found
        twice = np.concatenate([x, x])
        hit = guess == twice
        target = hit * np.int32(65000)
        target -= rate
        target >>= 5
        target += rate
        self.right[at] = target
        sure *= hit
        sure += 1
        np.minimum(sure, 7, out=sure)
        sure <<= 16
        sure |= twice
        self.seen[slot] = sure
        n = self.lanes
        now = x * np.int64(0x9E3779B1)
        np.bitwise_xor(now, self.one, out=self.key[n:])
        self.key[:n] = now
        self.one = x * np.int64(0xC2B2AE35)


MIN = 1 << 32
TOP = 1 << 48


def _unit(size: np.ndarray, total: np.ndarray) -> np.ndarray:
    """size // total, exact: below 2^48 the rounding of a double cannot reach the next whole number."""
    return (size / total).astype(np.int64)


class _Writer:
    """Range coder of all lanes: 48-bit state, a word of 16 bits leaves when the range is below 2^32."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, TOP, dtype=np.int64)
        # words with their carry above bit 16; lanes are neighbours, as they are at nearly the same word
        self.out = np.zeros((steps * 2 + 8, lanes), dtype=np.int32)
        self.flat = self.out.reshape(-1)
        self.lanes, self.at = lanes, np.arange(lanes, dtype=np.int64)

    def put(self, start, size, total) -> None:
        unit = _unit(self.range, total)
        self.low += unit * start
        self.range = unit * size
        due = self.range < MIN
        while due.any():
            self.flat[self.at] = self.low >> 32  # a lane that is not due writes this place again
            self.at += due * self.lanes
            self.low = np.where(due, (self.low & (MIN - 1)) << 16, self.low)
            self.range <<= due * 16
            due = self.range < MIN

    def finish(self) -> list[bytes]:
        for _ in range(3):
            self.flat[self.at] = self.low >> 32
            self.at += self.lanes
            self.low = (self.low & (MIN - 1)) << 16
        used, words = (self.at // self.lanes).tolist(), self.out
        for t in range(max(used) - 1, 0, -1):
            words[t - 1] += words[t] >> 16
        words = np.ascontiguousarray((words & 65535).astype(">u2").T)
        return [words[i, :n].tobytes() for i, n in enumerate(used)]


class _Reader:
    """The other side of ``_Writer``; ``code`` is relative to the lower end of the range."""

    def __init__(self, blocks: list[bytes]):
        lanes, size = len(blocks), max(map(len, blocks)) // 2 + 8
        # beyond the end of a damaged block zeros are read; its checksum tells
        words = np.zeros((lanes, size), dtype=np.uint16)
        for i, b in enumerate(blocks):
            words[i, :len(b) // 2] = np.frombuffer(b, dtype=">u2")
        words = words.T.astype(np.int32)  # lanes are neighbours
        w = words[:3].astype(np.int64)
        self.code = (w[0] << 32) | (w[1] << 16) | w[2]
        self.flat = np.ascontiguousarray(words).reshape(-1)
        self.range = np.full(lanes, TOP, dtype=np.int64)
        lane = np.arange(lanes, dtype=np.int64)
        self.lanes, self.at, self.end = lanes, lane + 3 * lanes, lane + (size - 1) * lanes

    def target(self, total) -> np.ndarray:
        self.unit = _unit(self.range, total)
        return np.minimum(_unit(self.code, self.unit), total - 1)

    def take(self, start, size) -> None:
        self.code -= self.unit * start
        self.range = self.unit * size
        due = self.range < MIN
        while due.any():
            word = self.flat.take(np.minimum(self.at, self.end))
            self.code = np.where(due, ((self.code << 16) | word) & (TOP - 1), self.code)
            self.at += due * self.lanes
            self.range <<= due * 16
            due = self.range < MIN


def _epochs(steps: int) -> Iterator[tuple[int, int]]:
    """The steps between updates of order 0: at 16, 32, 64, ... and at every ``UPDATE`` ids."""
    t, end = 0, 16
    while t < steps:
        yield t, min(end, steps)
        t, end = end, end + min(end, UPDATE)


def _write(x: np.ndarray, coder: _Writer) -> None:
    """Code the ids ``x`` (lanes, steps)."""
    lanes, steps = x.shape
    m = _Model(lanes)
    for begin, end in _epochs(steps):
        past = _History(x[:, :begin])
        own, twice = past.total, np.concatenate([past.total] * 2)
        starts, sizes = (np.ascontiguousarray(v.T) for v in past.find(x[:, begin:end]))
        for t, now in enumerate(np.ascontiguousarray(x[:, begin:end].T)):
            guess, w1, w2 = m.predictions(twice)
            hit = guess == np.concatenate([now, now])
            upper = own + w1
            start, size = starts[t], sizes[t]
            # the predictions that came true are few
            by1 = np.flatnonzero(hit[:lanes] & (w1 > 0))
            start[by1], size[by1] = own[by1], w1[by1]
            by2 = np.flatnonzero(hit[lanes:] & (w2 > 0))
            start[by2], size[by2] = upper[by2], w2[by2]
            coder.put(start, size, upper + w2)
            m.learn(now)


def _read(x: np.ndarray, coder: _Reader) -> None:
    """Fill ``x`` (lanes, steps) with the coded ids."""
    lanes, steps = x.shape
    m = _Model(lanes)
    for begin, end in _epochs(steps):
        past = _History(x[:, :begin])
        places, own, twice = past.places(), past.total, np.concatenate([past.total] * 2)
        rows = np.empty((end - begin, lanes), dtype=np.int32)
        for t in range(end - begin):
            guess, w1, w2 = m.predictions(twice)
            upper = own + w1
            goal = coder.target(upper + w2)
            if begin:
                # a place of the history, or the one of a new id or a prediction, which replace it
                place = _unit(goal - ALL_NEW, past.unit)
                np.clip(place, 0, begin - 1, out=place)
                place += past.edge
                packed = places.take(place)
                now = packed & 65535
                start = (packed >> 32) * past.unit
                start += ALL_NEW
                size = ((packed >> 16) & 65535) * past.unit
                new = np.flatnonzero(goal < ALL_NEW)
                ids = NEW_ID.take(goal[new])
                now[new], start[new], size[new] = ids, NEW_FROM.take(ids), NEW.take(ids)
            else:
                now = NEW_ID.take(np.minimum(goal, ALL_NEW - 1))
                start, size = NEW_FROM.take(now), NEW.take(now)
            at = np.flatnonzero(goal >= own)
            if len(at):
                second = goal[at] >= upper[at]
                now[at] = guess[at + second * lanes]
                start[at] = np.where(second, upper[at], own[at])
                size[at] = np.where(second, w2[at], w1[at])
            coder.take(start, size)
            rows[t] = now
            m.learn(rows[t])
        x[:, begin:end] = rows.T


def block_sizes(n: int) -> list[int]:
    """Nearly equal block lengths for ``n`` ids."""
    if not n:
        return []
    length = min(max(-(-n // FEW_LANES), 256), BLOCK)
    count = -(-n // length)
    return [n // count + (i < n % count) for i in range(count)]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    n = -(-len(sizes) // LANES)
    cut = [len(sizes) * i // n for i in range(n + 1)] if n else []
    yield from zip(cut, cut[1:])


def encode_blocks(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(ids, CRC-32, bytes) of every block; ids are below 65,536."""
    sizes = block_sizes(len(ids))
    ends = np.cumsum([0, *sizes])
    out = []
    for i, j in _groups(sizes):
        steps = max(sizes[i:j])
        x = np.zeros((j - i, steps), dtype=np.int32)  # a block one shorter is filled up by a zero
        for r in range(i, j):
            x[r - i, :sizes[r]] = ids[ends[r]:ends[r + 1]]
        coder = _Writer(j - i, steps)
        _write(x, coder)
        for r, b in zip(range(i, j), coder.finish()):
            out.append((sizes[r], zlib.crc32(ids[ends[r]:ends[r + 1]].astype("<u4").tobytes()), b))
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of the blocks (ids, CRC-32, bytes); raises ValueError where a checksum differs."""
    parts = []
    for i, j in _groups([n for n, _, _ in blocks]):
        steps = max(n for n, _, _ in blocks[i:j])
        x = np.zeros((j - i, steps), dtype=np.int32)
        _read(x, _Reader([b for _, _, b in blocks[i:j]]))
        for r in range(i, j):
            own = x[r - i, :blocks[r][0]].astype("<u4")
            if zlib.crc32(own.tobytes()) != blocks[r][1]:
                raise ValueError(f"checksum of block {r} differs")
            parts.append(own)
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def write_frame(part: int, number: int, keys: list, counts: list[int], ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    body = b"".join([
        np.array([k or 0 for k in keys], dtype="<i8").tobytes(),
        np.array([k is None for k in keys], dtype=np.uint8).tobytes(),
        np.array(counts, dtype="<i8").tobytes(),
        np.array([(n, len(b), c) for n, c, b in blocks], dtype="<u4").tobytes(), *[b for _, _, b in blocks]])
    return HEAD.pack(MAGIC, len(body), part, number, len(keys), len(ids), len(blocks)) + body


def read_frames(data: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(partition, frame, keys, numbers of ids, ids) of every frame of a file."""
    pos = 0
    while pos + HEAD.size <= len(data):
        magic, size, part, number, n_docs, n_ids, n_blocks = HEAD.unpack_from(data, pos)
        pos += HEAD.size
        if magic != MAGIC or pos + size > len(data):
            raise ValueError("not a frame, or cut off")
        at = pos
        keys = np.frombuffer(data, "<i8", n_docs, at)
        null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        counts = np.frombuffer(data, "<i8", n_docs, at + 9 * n_docs)
        table = np.frombuffer(data, "<u4", 3 * n_blocks, at + 17 * n_docs).reshape(-1, 3)
        at += 17 * n_docs + 12 * n_blocks
        ends = at + np.cumsum([0, *table[:, 1].tolist()])
        ids = decode_blocks([(int(n), int(c), data[a:b]) for (n, _, c), a, b in zip(table, ends, ends[1:])])
        if len(ids) != n_ids:
            raise ValueError("number of ids differs")
        yield part, number, [None if z else k for k, z in zip(keys.tolist(), null.tolist())], counts, ids
        pos += size + 1


# -- tokenising ---------------------------------------------------------------------------

CACHE = 400_000
JOINED = 50  # new words that are encoded in one string, the end token's string between them
#: An ASCII sign other than the apostrophe, after an ASCII or Latin-1 letter or a digit: there the tokenizer's
#: own split always cuts, so a space before it changes no id.
_SIGN = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))", re.DOTALL)


def cut_words(text: str) -> list[bytes]:
    """Pieces of a text at which the tokenizer's own split always cuts, with ASCII letters in lower case.

    The tokenizer composes marks before it lower-cases, so case is left where a mark (U+0300 to U+037F) could follow.
    """
    data = text.encode()
    if b"\xcc" not in data and b"\xcd" not in data:
        data = _SIGN.sub(rb" \g<0>", data.lower())
    return data.split()


class _Tokens(dict):
    """Word to its ids as 16-bit integers in bytes. Words are those of ``cut_words``; the tokenizer drops
    the white space between them, so a text's ids are those of its words.

    The tokenizer makes one id of the string of an added token wherever it stands, across words too; a text
    that holds one (in any case, as texts may be lower-cased first) is encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content.lower() for t in added.values()]
        self.cut = max(added)
        self.between = f" {added[self.cut].content} "

    def whole(self, text: str) -> bytes | None:
        """Ids of a text that must be encoded as a whole, or nothing."""
        low = text.lower()
        if not any(t in low for t in self.added):
            return None
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def fill(self, words: set[bytes]) -> None:
        """Encode the words that are not known yet in one call; beyond ``CACHE`` words start anew."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(words)
        # no word holds an added token, so the string of one between words comes out as its id and nothing else does
        groups = [new[i:i + JOINED] for i in range(0, len(new), JOINED)]
        texts = [self.between.join([w.decode() for w in g]) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u2")
            cut = np.flatnonzero(ids == self.cut)
            ids, ends = ids.tobytes(), (2 * cut).tolist()
            for w, a, b in zip(group, [0, *[x + 2 for x in ends]], [*ends, len(ids)]):
                self[w] = ids[a:b]


@lru_cache(maxsize=1)
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


def write_ids(df: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text",
              end_id: int = END_ID, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of the key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        known, part, number = _tokens(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u2").tobytes()
        keys, counts, held, size = [], [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part_keys = batch.column(0).slice(a, 500).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(a, 500).to_pylist()]
                whole = [known.whole(t) for t in texts]
                texts = [cut_words(t) if x is None else [] for t, x in zip(texts, whole)]
                known.fill(set().union(*texts))
                for k, words, x in zip(part_keys, texts, whole):
                    ids = (b"".join([known[w] for w in words]) if x is None else x) + end
                    keys.append(k)
                    counts.append(len(ids) // 2)
                    held.append(ids)
                    size += len(ids) // 2
                    if size >= FRAME_IDS:
                        yield _frame_row(part, number, keys, counts, held)
                        keys, counts, held, size, number = [], [], [], 0, number + 1
        if keys:
            yield _frame_row(part, number, keys, counts, held)

    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(n_partitions(df.sparkSession), -(-size // part_bytes))
    # the row number only lets a key that many rows carry be split over partitions
    ordered = (docs.withColumn("tie", F.monotonically_increasing_id())
               .repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie"))
    frames = ordered.select("key", "text").mapInArrow(run, "value binary")
    frames.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _frame_row(part, number, keys, counts, held) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(held), dtype="<u2")
    return pa.RecordBatch.from_arrays([pa.array([write_frame(part, number, keys, counts, ids)], pa.binary())], ["value"])


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, ``start`` (ids of all documents before it) and ``data`` (its ids, little-endian 32 bits) per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, number, keys, counts, ids in read_frames(content.as_py()):
                    ends = np.cumsum([0, *counts.tolist()])
                    n = len(keys)
                    offsets = pa.py_buffer((ends * 4).astype(np.int32).tobytes())
                    data = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part)), pa.array(np.full(n, number)), pa.array(keys, pa.int64()),
                         pa.array(ends[:-1]), data], names=["part", "frame", "key", "at", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = stored(files.select("content").mapInArrow(
        run, "part long, frame long, key long, at long, data binary"), "ids")
    totals = rows.groupBy("part", "frame").agg(F.sum(F.octet_length("data") / 4).cast("long").alias("n"))
    # a running sum over one row per frame; stored, so that the planner knows its size and only joins it by
    # broadcast, without moving the ids, where it is under the session's threshold
    before = stored(totals.select("part", "frame", (
        F.sum("n").over(Window.orderBy("part", "frame")) - F.col("n")).alias("before")), "frames")
    return rows.join(before, ["part", "frame"]).select(
        F.col("key").alias(key), (F.col("before") + F.col("at")).alias("start"), "data")
