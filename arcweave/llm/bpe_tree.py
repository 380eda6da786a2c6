"""Byte-level BPE by monoid tree reduction, and decoding up the same kind of tree.

Texts are cut by a split pattern (one in which a space joins the word after it); each match is
encoded by itself. A match that is a
vocabulary entry is that token. Any other is halved recursively; two encoded neighbours are
joined by re-encoding a window around the border, one token on each side at first, doubled on
the side that is not yet stable.

When to stop: a token sequence is the BPE encoding of its bytes exactly if each pair of
neighbouring tokens is the encoding of the pair's own bytes (a merge across a border that
happens in the whole also happens with only the two tokens that touch it). Both halves are
encodings, so all pairs inside them hold, and so do those in the re-encoded window. Once the
two pairs at the window's edges hold as well, no token outside can change. The operation is
associative with the empty sequence as its unit, so any bracketing gives the same tokens.

Work runs in Arrow batches. Each Python worker keeps encodings of recent matches, pairs and
short byte strings in dictionaries of bounded size; what is dropped is computed again.

Defined results: a null text is empty; an empty text has no tokens and decodes to no bytes; rows
are independent, so repeated rows, null or repeated ids and ties need no rule; an empty table
gives an empty result; only the key and text columns are looked at.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 40         # rank of what is no token
CACHE = 300_000       # matches, pairs and short strings kept by a worker
SLICE_BYTES = 4 << 20  # text turned into one output batch
SHORT = 6             # byte strings up to this length are kept
FAN = 64              # children of a node of the decoding tree


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self._short: dict[bytes, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    # -- merging a byte string directly; used for windows only ------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Encoding of ``data`` by repeated merging of the leftmost lowest-ranked pair."""
        ranks = self.ranks
        if len(data) > 48:
            return self._merge_long(data)
        parts = [data[i:i + 1] for i in range(len(data))]
        found = [ranks.get(data[i:i + 2], NONE) for i in range(len(data) - 1)]
        while found:
            best = min(found)
            if best == NONE:
                break
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at < len(found):
                found[at] = ranks.get(parts[at] + parts[at + 1], NONE)
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + parts[at], NONE)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list, for windows of any length."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))       # end of the part that starts at i; 0: merged away
        before = list(range(-1, n - 1))   # start of the part to the left
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(data[i:end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    # -- the monoid ------------------------------------------------------------------------

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """Encoding of the bytes of two tokens."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            found = self._pairs[a, b] = tuple(self.merge(self.token[a] + self.token[b]))
        return found

    def stable(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their own bytes."""
        return self.pair(a, b) == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            if i == j == 1:
                mid = self.pair(left[-1], right[0])
            else:
                mid = tuple(self.merge(b"".join(map(self.token.__getitem__, left[len(left) - i:] + right[:j]))))
            ok_left = i == len(left) or self.stable(left[-i - 1], mid[0])
            ok_right = j == len(right) or self.stable(mid[-1], right[j])
            if ok_left and ok_right:
                return left[:len(left) - i] + mid + right[j:]
            i = i if ok_left else min(2 * i, len(left))
            j = j if ok_right else min(2 * j, len(right))

    def encode_tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= SHORT:
            found = self._short.get(data)
            if found is None:
                if len(self._short) >= CACHE:
                    self._short.clear()
                half = len(data) // 2
                found = (self.join(self.encode_tree(data[:half]), self.encode_tree(data[half:]))
                         if half else tuple(self.ranks[data[i:i + 1]] for i in range(len(data))))
                self._short[data] = found
            return found
        half = len(data) // 2
        return self.join(self.encode_tree(data[:half]), self.encode_tree(data[half:]))

    def encode_match(self, match: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(match)
        return (whole,) if whole is not None else self.encode_tree(match)

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of the tokens, concatenated level by level."""
        level = [self.token[t] for t in ids]
        while len(level) > 1:
            level = [b"".join(level[i:i + FAN]) for i in range(0, len(level), FAN)]
        return level[0] if level else b""


class _Known(dict):
    """Match to its ids, as 32-bit integers in bytes; computes what is missing.

    Two generations of at most ``CACHE`` entries: a full one is kept for lookups until the next is full.
    """

    def __init__(self, bpe: TreeBpe, find):
        super().__init__()
        self.bpe, self.find, self.old = bpe, find, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.old.get(match)
        if ids is None:
            ids = array("i", self.bpe.encode_match(match.encode())).tobytes()
        if len(match) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[match] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a text."""
        return b"".join(map(self.__getitem__, self.find(text)))


class _Pieces(_Known):
    """The same for pieces of a text that follow a single space (which is not part of the key)."""

    def __init__(self, matches: _Known):
        super().__init__(matches.bpe, matches.find)
        self.matches = matches

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.matches.ids(" " + piece)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """A match ends before every space between two characters that are no white space, and the
        next begins with that space, so a text without other spaces can be cut there."""
        if not text or _odd_space(text):
            return self.matches.ids(text)
        first, *rest = text.split(" ")
        return self.matches.ids(first) + b"".join([self[x] for x in rest])


def _odd_space(text: str) -> bool:
    """Whether a space of ``text`` is next to other white space, or at an end."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return True
    return any(c in text and (" " + c in text or c + " " in text) for c in _OTHER_SPACE)


_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


@lru_cache(maxsize=1)
def _worker(path: str, pattern: str) -> tuple[TreeBpe, _Pieces]:
    bpe = TreeBpe(load_ranks(path))
    return bpe, _Pieces(_Known(bpe, regex.compile(pattern).findall))


def _slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(size) // limit
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for i, j in zip(cut, cut[1:]):
        yield batch.slice(i, j - i)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id",
                  text: str = "text", keep_text: bool = False) -> DataFrame:
    """key, ``ids`` (array of int) and ``decoded`` (the bytes that the ids stand for), per input row; with
    ``keep_text`` also the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = _worker(ranks_path, pattern)
        for batch in batches:
            for part in _slices(batch, 1):
                texts = part.column(1).to_pylist()
                ids = [known.ids(t) if t else b"" for t in texts]
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                decoded = [bpe.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                out = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                       pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(out + [part.column(1)] * keep_text, names=names)

    src = df.select(F.col(key), F.col(text))
    kind = src.schema[0].dataType.simpleString()
    names = [key, "ids", "decoded", "text"][:4 if keep_text else 3]
    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary" + ", text string" * keep_text)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens, SHA-256 of the ids in decimal joined by commas, and SHA-256 of the decoded bytes."""
    return coded.select(
        F.col(key), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
