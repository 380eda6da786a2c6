"""Vectorised word splitting and hashing of UTF-8 text buffers (numpy, used inside tasks).

A chunk of documents is one byte buffer plus offsets. Words are maximal runs of bytes other
than ASCII white space and never cross a document border. Hashes are 64-bit polynomial sums
(wrapping arithmetic) over tables of fixed pseudo-random numbers, so they are equal on every
worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 4 << 20  # work on about this much text at once; one document is never split


def splitmix(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers (the splitmix64 sequence of ``seed``)."""
    z = U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@lru_cache(maxsize=8)
def _tables(seed: int) -> tuple[np.ndarray, U64, U64]:
    r = splitmix(seed * 1000 + 7, 260)
    return r[:256], r[256] | U64(1), r[257] | U64(1)


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=U64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=U64)


@dataclass
class Words:
    """Words of some documents: byte ranges in ``data``; ``first[d] : first[d + 1]`` are those of document d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 1) -> np.ndarray:
        n = len(self.start)
        if n == 0:
            return np.zeros(0, dtype=U64)
        table, base, _ = _tables(seed)
        lens = self.end - self.start
        at = np.cumsum(lens) - lens  # word starts among the bytes of all words
        rel = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
        src = rel + np.repeat(self.start, lens)
        val = table[self.data[src]] * powers(base, int(lens.max()))[rel]
        return mix(np.add.reduceat(val, at))

    def windows(self, h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
        """Hash of the ``k`` words from each word on; only meaningful inside one document."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=U64)
        _, _, base = _tables(seed)
        out = np.zeros(n, dtype=U64)
        if k <= 12:
            for j in range(k):
                out = out * base + h[j:j + n]
            return mix(out)
        p = powers(int(base), len(h) + 1)
        inv = powers(pow(int(base), -1, 1 << 64), n)
        s = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * p[:-1], out=s[1:])
        return mix((s[k:] - s[:n]) * inv)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """``offsets`` (n_docs + 1) are positions in ``data``; the text of document d lies between two of them."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    b = data[lo:hi]
    off = (offsets - lo).astype(np.int64)
    n = len(b)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return Words(b, off, z, z, np.zeros(len(off), dtype=np.int64))
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:n])).astype(np.int64)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])).astype(np.int64) + 1
    return Words(b, off, start, end, np.searchsorted(start, off))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string (or binary) array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] \
        if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes; a longer document is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def digests(w: Words, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the word sequence of every document."""
    out = []
    count = np.diff(w.first)
    place = np.arange(len(h1)) - np.repeat(w.first[:-1], count)
    for seed, h in ((11, h1), (12, h2)):
        total = np.zeros(len(h) + 1, dtype=U64)
        # a word counts as the hash of it and its place, so order matters
        np.cumsum(mix(h + mix(place.astype(U64) * U64(2 * seed + 1) + U64(seed))), out=total[1:])
        out.append(mix(total[w.first[1:]] - total[w.first[:-1]] + count.astype(U64)))
    return out[0], out[1]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
