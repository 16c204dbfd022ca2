"""Fill-in-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of about ``FRAME_BYTES`` bytes,
each with the number of units, code points and bytes before it, so any unit can
be reached by decompressing the one frame that holds it.  Units are the matches
of ``[A-Za-z]+|[^A-Za-z]`` from left to right over code points.

``store`` writes the frames of a table, ``fill_in_middle`` cuts the stored texts
into prefix, middle and suffix and writes them in another order: cut frames are
decompressed to find the cuts, then the frames stream in the output's order
through the digests.  The text that the output and its form give back is
digested too; only its suffix waits, in frames, until the middle has passed.
``units`` reads a stretch of units, ``texts`` the whole text.

Nulls and empty texts have no frames and no units; their form is plain.  Very
long texts are held as frames, and one frame at a time as bytes (``output``
texts, where asked for, and single Arrow values are whole).  Nothing depends on
other rows: repeated rows and ties give equal results, an empty table gives an
empty one, other columns travel in ``row`` as they are, whatever their names.  A
null id counts as empty text in the hash that places the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import chunks, lean, saved

FRAME_BYTES = 1 << 16
LEVEL = 1

# --- fixed values: the markers of the three parts, and the hash's salt --------
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SALT = "1:"
PLAIN_FROM, SPM_BELOW = 90, 20
# --- end fixed values ---------------------------------------------------------

FRAME = T.StructType([T.StructField("units", T.LongType()), T.StructField("chars", T.LongType()),
                      T.StructField("bytes", T.LongType()), T.StructField("inside", T.BooleanType()),
                      T.StructField("data", T.BinaryType())])
_ARROW_FRAME = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("inside", pa.bool_()),
                          ("data", pa.binary())])

#: Bytes A-Z and a-z; bytes that continue a code point.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True


def unit_starts(data: np.ndarray, fresh: np.ndarray | None = None) -> np.ndarray:
    """Which bytes begin a unit; ``fresh`` marks bytes with no byte before them
    (of their text), by default the first one."""
    letter = LETTER[data]
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    if fresh is not None:
        before &= ~fresh
    return ~CONTINUES[data] & ~(letter & before)


def cuts(data: np.ndarray, lo: int, hi: int, size: int) -> list[int]:
    """Ends of the frames of the text data[lo:hi], never inside a code point."""
    out = []
    while hi - lo > size:
        at = lo + size
        while at > lo and CONTINUES[data[at]]:
            at -= 1
        lo = at if at > lo else lo + size
        out.append(lo)
    return [*out, hi] if hi > lo else out


def store(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None,
          frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``row`` (the columns in ``carry``), ``frames`` and the totals ``n_units``,
    ``n_chars``, ``n_bytes`` of each text, and whether it holds a marker
    (``marked``); a table in the shared folder."""
    carry = carry or [c for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([src.schema["row"], T.StructField("frames", T.ArrayType(FRAME)),
                           *[T.StructField(n, T.LongType()) for n in ("n_units", "n_chars", "n_bytes")],
                           T.StructField("marked", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for t in chunks(batch, "text"):
                n = len(t.data)
                fresh = np.zeros(n, bool)
                fresh[t.offsets[:-1][t.offsets[:-1] < n]] = True
                units = np.append(0, np.cumsum(unit_starts(t.data, fresh)))
                chars = np.append(0, np.cumsum(~CONTINUES[t.data]))
                frames, offs, marked = [], [0], []
                for lo, hi in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist()):
                    at = lo
                    for end in cuts(t.data, lo, hi, frame_bytes):
                        inside = at > lo and bool(LETTER[t.data[at]] and LETTER[t.data[at - 1]])
                        frames.append((int(units[at] - units[lo]), int(chars[at] - chars[lo]), at - lo, inside,
                                       pack.compress(t.data[at:end].tobytes())))
                        at = end
                    offs.append(len(frames))
                    text = t.data[lo:hi].tobytes()
                    marked.append(PREFIX in text or SUFFIX in text or MIDDLE in text)
                cols = list(zip(*frames)) or [()] * 5
                values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW_FRAME)],
                                                    fields=list(_ARROW_FRAME))
                o = t.offsets
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[t.rows], pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values),
                     pa.array(units[o[1:]] - units[o[:-1]]), pa.array(chars[o[1:]] - chars[o[:-1]]), pa.array(np.diff(o)),
                     pa.array(marked, pa.bool_())], schema.names)

    return saved(src.mapInArrow(lean(run), schema))


class Seekable:
    """One stored text: frames (units, chars, bytes, inside, data) in order."""

    def __init__(self, frames: list[dict], n_units: int, n_chars: int, n_bytes: int):
        self.frames, self.total = frames, (n_units, n_chars, n_bytes)
        self._open = zstandard.ZstdDecompressor()
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self._last = (k, self._open.decompress(self.frames[k]["data"]))
        return self._last[1]

    def seek(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before a unit (the text's end for the unit after
        the last), from the one frame in which it begins."""
        if unit >= self.total[0]:
            return self.total[2], self.total[1]
        lo, hi = 0, len(self.frames)
        while hi - lo > 1:  # the last frame with at most so many units before it
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.frames[mid]["units"] <= unit else (lo, mid)
        f = self.frames[lo]
        data = np.frombuffer(self.frame(lo), np.uint8)
        starts = unit_starts(data)
        if f["inside"]:
            starts[0] = False
        at = int(np.flatnonzero(starts)[unit - f["units"]])
        return f["bytes"] + at, f["chars"] + int((~CONTINUES[data[:at]]).sum())

    def read(self, lo: int, hi: int) -> Iterator[bytes]:
        """The bytes lo to hi of the text, frame by frame."""
        for k, f in enumerate(self.frames):
            end = self.frames[k + 1]["bytes"] if k + 1 < len(self.frames) else self.total[2]
            if f["bytes"] < hi and end > lo:
                yield self.frame(k)[max(lo - f["bytes"], 0):hi - f["bytes"]]


def arranged(text: Seekable, form: str, a: int, b: int) -> Iterator[bytes]:
    """The output's pieces in order; ``a`` and ``b`` are the cuts in bytes."""
    n = text.total[2]
    if form == "plain":
        yield from text.read(0, n)
        return
    parts = {PREFIX: (0, a), SUFFIX: (b, n), MIDDLE: (a, b)}
    for mark in ((PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)):
        yield mark
        yield from text.read(*parts[mark])


def restored(output: Iterable[bytes], form: str) -> Iterator[bytes]:
    """The text that an output of the given form came from.

    The markers are looked for in the stream, also across its pieces.  What
    lies in the suffix is kept in frames until the middle has passed.
    """
    if form == "plain":
        yield from output
        return
    marks = list((PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE))
    pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    kept: list[bytes] = []
    part, rest = b"", b""
    for piece in output:
        rest += piece
        while marks and (at := rest.find(marks[0])) >= 0:
            if part == SUFFIX:
                kept.append(pack.compress(rest[:at]))
            else:
                yield rest[:at]
            part, rest = marks.pop(0), rest[at + 3:]
        cut = max(len(rest) - 2, 0) if marks else len(rest)  # a marker may go on in the next piece
        if cut:
            if part == SUFFIX:
                kept.append(pack.compress(rest[:cut]))
            else:
                yield rest[:cut]
        rest = rest[cut:]
    yield rest
    for frame in kept:
        yield unpack.decompress(frame)


def decisions(id_col: Column, n: Column, marked: Column) -> dict[str, Column]:
    """Cuts ``a`` and ``b`` in units, and the form, from the hash of the id."""
    digest = F.sha2(F.concat(F.lit(SALT), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    x, y = F.pmod(h[0], n + 1), F.pmod(h[1], n + 1)
    form = (F.when((n == 0) | marked | (F.pmod(h[2], F.lit(100)) >= PLAIN_FROM), "plain")
            .when(F.pmod(h[3], F.lit(100)) < SPM_BELOW, "spm").otherwise("psm"))
    return {"a": F.least(x, y), "b": F.greatest(x, y), "form": form}


def _texts_of(batch: pa.RecordBatch) -> Iterator[Seekable]:
    for k in range(batch.num_rows):
        yield Seekable(batch.column("frames")[k].as_py() or [],
                       *[batch.column(c)[k].as_py() for c in ("n_units", "n_chars", "n_bytes")])


def _over(stored: DataFrame, extra: list[Column], fields: list[T.StructField], values) -> DataFrame:
    """``row`` and what ``values(text, extra values)`` gives for each stored text."""
    src = stored.select("row", "frames", "n_units", "n_chars", "n_bytes", *extra)
    schema = T.StructType([src.schema["row"], *fields])
    names = src.columns[5:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*[batch.column(c).to_pylist() for c in names]) if names else [()] * batch.num_rows
            rows = [values(text, *g) for text, g in zip(_texts_of(batch), given)]
            cols = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(c, kinds[f.dataType.typeName()]) for c, f in
                                                                      zip(cols, fields)]], schema.names)

    kinds = {"long": pa.int64(), "string": pa.string()}
    return src.mapInArrow(lean(run), schema)


def fill_in_middle(stored: DataFrame, id_col: str = "doc_id", with_output: bool = False) -> DataFrame:
    """``row``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if
    plain), ``output_sha256``, ``restored_sha256``, and with ``with_output`` the
    ``output`` itself, for each text of ``store``."""
    how = decisions(F.col(f"row.`{id_col}`"), F.col("n_units"), F.col("marked"))
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
              T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
              T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    if with_output:
        fields.append(T.StructField("output", T.StringType()))

    def values(text: Seekable, a: int, b: int, form: str) -> tuple:
        chars: tuple[int | None, int | None] = (None, None)
        at, to = 0, 0
        if form != "plain":
            (at, c1), (to, c2) = text.seek(a), text.seek(b)
            chars = (c1, c2 - c1)
        seen, back, kept = hashlib.sha256(), hashlib.sha256(), []

        def pieces() -> Iterator[bytes]:
            for piece in arranged(text, form, at, to):
                seen.update(piece)
                if with_output:
                    kept.append(piece)
                yield piece

        for piece in restored(pieces(), form):
            back.update(piece)
        out = (text.total[0], form, *chars, seen.hexdigest(), back.hexdigest())
        return (*out, b"".join(kept).decode()) if with_output else out

    return _over(stored, [how[c].alias(c) for c in ("a", "b", "form")], fields, values)


def units(stored: DataFrame, first: Column, last: Column) -> DataFrame:
    """``row`` and the units ``first`` to ``last`` (without it) as ``text``; only
    the frames that hold them are decompressed."""
    def values(text: Seekable, a: int | None, b: int | None) -> tuple:
        if a is None or b is None:
            return (None,)
        lo, hi = text.seek(max(a, 0))[0], text.seek(max(b, 0))[0]
        return (b"".join(text.read(lo, hi)).decode(),)

    return _over(stored, [first.cast("long").alias("_from"), last.cast("long").alias("_to")],
                 [T.StructField("text", T.StringType())], values)


def texts(stored: DataFrame) -> DataFrame:
    """``row`` and the whole ``text`` (nulls come back empty)."""
    return _over(stored, [], [T.StructField("text", T.StringType())],
                 lambda text: (b"".join(text.read(0, text.total[2])).decode(),))
