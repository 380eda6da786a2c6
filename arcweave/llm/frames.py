"""Fill-in-middle transformation over texts kept as seekable compressed frames.

A text is a row of independent zstandard frames of about ``FRAME_BYTES`` of whole units each, and for
every frame the number of units, code points and bytes before it. A unit is white space with the run of other
characters after it, or white space at the end of the text. To find the n-th unit,
the counts name its frame and only that frame is decompressed; a span is read
by decompressing the frames that hold it, one after the other.

1. ``store`` cuts and compresses every text once and writes the table of frames, one row for each
   document: arrays of counts and of frames. A task holds one text at a time.
2. ``fill_in_middle`` reads that table, chooses two cuts by the SHA-256 of ``<seed>:<key>``, seeks them
   in their frames and streams prefix, suffix and middle in the order of the form, frame by frame.
   The output is again written as frames, while its digest is taken; the text is rebuilt from these frames
   and the form alone: the marks are searched in the stream, then the spans are read in
   the order of the text. No step holds a whole text beside its frames.

``select_units`` reads any spans of units from the table of frames.

Defined results: a null text is empty (no frame, no unit, form plain); a null key is hashed as
the text ``null``; every row is decided by its own key and text, so repeated rows give
repeated results; a text that holds a mark stays plain; one unit longer than a frame is a frame of its
own; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import stored

FRAME_BYTES = 1 << 16
LEVEL = 3
MARKS = (b"<P>", b"<S>", b"<M>")  # before prefix, suffix and middle
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LISTS = {"units": pa.int64(), "chars": pa.int64(), "bytes": pa.int64(), "frames": pa.binary()}


def unit_ends(data: bytes) -> np.ndarray:
    """Byte places at which the units of ``data`` end (UTF-8; only ASCII white space parts units)."""
    if not data:
        return np.zeros(0, np.int64)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(data))


def n_points(data: bytes) -> int:
    """Code points of UTF-8 bytes: all bytes that do not continue one."""
    b = np.frombuffer(data, np.uint8)
    return len(b) - int(np.count_nonzero((b & 0xC0) == 0x80))


class Frames(NamedTuple):
    """Units, code points and bytes before each frame, with the totals as last entry; and the frames."""
    units: list[int]
    chars: list[int]
    bytes: list[int]
    frames: list[bytes]


class FrameWriter:
    """Takes pieces of bytes and cuts them into frames of whole units, if ``whole_units``, or of equal size."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.zip = zstandard.ZstdCompressor(level=level)
        self.limit = frame_bytes
        self.done = Frames([0], [0], [0], [])
        self.rest: list[bytes] = []
        self.size = 0

    def _frame(self, data: bytes, units: int) -> None:
        d = self.done
        d.units.append(d.units[-1] + units)
        d.chars.append(d.chars[-1] + n_points(data))
        d.bytes.append(d.bytes[-1] + len(data))
        d.frames.append(self.zip.compress(data))

    def text(self, data: bytes) -> Frames:
        """Frames of a whole text, each ending with a unit."""
        ends, at, begin = unit_ends(data), 0, 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, begin + self.limit, side="right")))
            self._frame(data[begin:ends[to - 1]], to - at)
            at, begin = to, int(ends[to - 1])
        return self.done

    def write(self, piece: bytes) -> None:
        """Add bytes of a stream; frames of a stream are cut by size and have no units."""
        self.rest.append(piece)
        self.size += len(piece)
        if self.size >= self.limit:
            self._frame(b"".join(self.rest), 0)
            self.rest, self.size = [], 0

    def close(self) -> Frames:
        if self.size:
            self._frame(b"".join(self.rest), 0)
            self.rest, self.size = [], 0
        return self.done


def _unzip(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def seek_unit(f: Frames, unit: int) -> tuple[int, int]:
    """(byte, code point) at which unit number ``unit`` begins; decompresses one frame at most."""
    j = int(np.searchsorted(f.units, unit, side="right")) - 1
    inside = unit - f.units[j]
    if not inside:
        return f.bytes[j], f.chars[j]
    data = _unzip(f.frames[j])
    end = int(unit_ends(data)[inside - 1])
    return f.bytes[j] + end, f.chars[j] + n_points(data[:end])


def read_bytes(f: Frames, begin: int, end: int) -> Iterator[bytes]:
    """Bytes ``begin`` to ``end`` in pieces, one frame decompressed at a time."""
    j = int(np.searchsorted(f.bytes, begin, side="right")) - 1
    while begin < end:
        data = _unzip(f.frames[j])
        yield data[begin - f.bytes[j]:end - f.bytes[j]]
        j += 1
        begin = f.bytes[j]


def cut_units(key: str, n: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """(units of the prefix, units before the suffix, two numbers that choose the form)."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    a, b, c, d = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    return min(a % (n + 1), b % (n + 1)), max(a % (n + 1), b % (n + 1)), c, d


def output_pieces(f: Frames, form: str, first: int, second: int) -> Iterator[bytes]:
    """The output, streamed from the frames of the text; the middle is bytes ``first`` to ``second``."""
    end = f.bytes[-1]
    if form == "plain":
        yield from read_bytes(f, 0, end)
        return
    spans = {b"<P>": (0, first), b"<S>": (second, end), b"<M>": (first, second)}
    for mark in (b"<P>", b"<S>", b"<M>") if form == "psm" else (b"<S>", b"<P>", b"<M>"):
        yield mark
        yield from read_bytes(f, *spans[mark])


def _find_marks(out: Frames) -> dict[bytes, int]:
    """Byte places of the marks in an output, found in one pass over its frames."""
    found: dict[bytes, int] = {}
    tail, at = b"", 0
    for frame in out.frames:
        data = tail + _unzip(frame)
        for mark in MARKS:
            if mark not in found and (i := data.find(mark)) >= 0:
                found[mark] = at + i
        keep = min(len(data), 2)  # a mark may lie across two frames
        at += len(data) - keep
        tail = data[len(data) - keep:]
    return found


def restored_pieces(out: Frames, form: str) -> Iterator[bytes]:
    """The text, rebuilt from the output and the form."""
    end = out.bytes[-1]
    if form == "plain":
        yield from read_bytes(out, 0, end)
        return
    at = _find_marks(out)
    p, s, m = (at[x] for x in MARKS)
    yield from read_bytes(out, p + 3, s if form == "psm" else m)  # prefix
    yield from read_bytes(out, m + 3, end)  # middle
    yield from read_bytes(out, s + 3, m if form == "psm" else p)  # suffix


def _digest(pieces: Iterable[bytes], keep: FrameWriter | None = None) -> str:
    h = hashlib.sha256()
    for piece in pieces:
        h.update(piece)
        if keep is not None:
            keep.write(piece)
    return h.hexdigest()


# ---------------------------------------------------------------- tables


def store(df: DataFrame, key: str = "doc_id", text: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The table of frames: key, ``marked`` (the text holds a mark), and arrays ``units``, ``chars``, ``bytes``
    (counts before each frame, then the totals) and ``frames``; written to the shared folder."""
    t = F.coalesce(F.col(text), F.lit(""))
    src = df.select(F.col(key), F.greatest(*[F.contains(t, F.lit(m.decode())) for m in MARKS]),
                    t.cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [FrameWriter(frame_bytes).text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     *[pa.array([getattr(r, c) for r in rows], pa.list_(t)) for c, t in _LISTS.items()]],
                    names=[key, "marked", *_LISTS])

    kind = src.schema[0].dataType.simpleString()
    return stored(src.mapInArrow(run, f"`{key}` {kind}, marked boolean, units array<long>, chars array<long>, "
                                      "bytes array<long>, frames array<binary>"), "frames")


def _frames(batch: pa.RecordBatch, first: int, row: int) -> Frames:
    return Frames(*[batch.column(first + i)[row].as_py() for i in range(4)])


def fill_in_middle(frames: DataFrame, key: str = "doc_id", seed: int = SEED, fim_percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT, with_output: bool = False,
                   frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Per row of a table of frames: key, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code
    points, null if plain), output_sha256, restored_sha256; with ``with_output`` also the output as
    ``output_bytes`` (counts) and ``output_frames``."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    src = frames.select(F.col(key), name, "marked", *_LISTS)

    def row(name: str, marked: bool, f: Frames) -> tuple:
        n = f.units[-1]
        a, b, c, d = cut_units(name, n, seed)
        form = ("plain" if not n or marked or c % 100 >= fim_percent else
                "spm" if d % 100 < spm_percent else "psm")
        (first, i), (second, j) = (seek_unit(f, a), seek_unit(f, b)) if form != "plain" else ((0, 0), (0, 0))
        out = FrameWriter(frame_bytes)
        sha = _digest(output_pieces(f, form, first, second), out)
        written = out.close()
        chars = (None, None) if form == "plain" else (i, j - i)
        return (n, form, *chars, sha, _digest(restored_pieces(written, form)), written.bytes, written.frames)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.list_(pa.int64()), pa.list_(pa.binary())]
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256",
             "output_bytes", "output_frames"]
    width = 8 if with_output else 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [row(part.column(1)[i].as_py(), part.column(2)[i].as_py(), _frames(part, 3, i))[:width]
                        for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]],
                    names=[key, *names[:width]])

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, "
                               "output_sha256 string, restored_sha256 string"
                               + ", output_bytes array<long>, output_frames array<binary>" * with_output)


def select_units(frames: DataFrame, first: str, last: str, key: str = "doc_id") -> DataFrame:
    """key and ``part``: the text of units ``first`` (included) to ``last`` (left out) of each row, two columns of
    the table of frames. Columns of counts choose the frames that hold the span; only these reach Python."""
    lo = F.greatest(F.least(F.col(first), F.element_at("units", -1)), F.lit(0))
    hi = F.greatest(F.least(F.col(last), F.element_at("units", -1)), lo)
    spans = frames.select(F.col(key), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), "units", "frames")
    # frame j holds units[j] to units[j + 1]
    a = F.size(F.filter("units", lambda u: u <= F.col("lo")))
    b = F.size(F.filter("units", lambda u: u < F.col("hi")))
    spans = spans.withColumn("a", F.least(a, F.size("frames"))).withColumn("b", F.least(b, F.size("frames")))
    held = spans.select(
        F.col(key), F.when(F.col("hi") > F.col("lo"), F.slice("frames", F.col("a"), F.col("b") - F.col("a") + 1))
        .otherwise(F.array().cast("array<binary>")),
        (F.col("lo") - F.element_at("units", F.greatest("a", F.lit(1)))), (F.col("hi") - F.col("lo")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = b"".join(map(_unzip, batch.column(1)[i].as_py()))
                skip, take = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                places = [0, *unit_ends(data).tolist()]
                text = data[places[skip]:places[skip + take]] if take else b""
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([text.decode()])],
                                                 names=[key, "part"])

    return held.mapInArrow(run, f"`{key}` {held.schema[0].dataType.simpleString()}, part string")
