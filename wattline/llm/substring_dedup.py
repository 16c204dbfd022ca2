"""Repeated passages of words, by recompression.

Words are compressed in rounds.  A round joins runs of equal neighbours, then
pairs of neighbours whose names fall into the left and the right half of the
names; joined symbols get a name that is a hash of their words, so that all
tasks name equal symbols alike without a dictionary.  Only symbols of at most
``limit`` words take part in a round (restricted recompression); so whether a
symbol ends at a place depends on ``CONTEXT`` words on either side of it and on
nothing else.  Equal passages therefore have equal symbols inside, and each
window of ``WIDTH`` words holds at least one symbol with that much context.
Of these the window picks the one with the smallest hash as its place (see
``repeats``): shared symbols with their context reveal the repeats, and the
windows around the ends of repeats are verified one by one by two 64-bit
hashes of their words.

Defined results: null texts have no words; documents shorter than a window
keep everything; windows never cross documents; only a smaller id counts as
earlier, so repeats inside a document, or between rows of one id, stay;
a null id is smaller than all others; long texts are read whole; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wattline.llm.common import SpanHash, Texts, U64, chunks, lean, mix, spans_to_mask, within, words
from wattline.llm.repeats import ME, SPANS, Columns, Repeats, dealt, find, keyed_documents, settle, taken, unpacked

WIDTH = 50
#: Largest symbols that take part in each round, for runs and for pairs.
LIMITS = (1, 2, 4)
#: Words on either side that a symbol's ends depend on.
CONTEXT = 2 * sum(LIMITS)

WINDOW = [("key", "u8"), ("twin", "u8"), *ME, ("start", "i4")]


def symbols(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Recompress words (their hashes) of documents that begin at ``first``:
    the first word of each symbol, and its name."""
    n = len(w)
    spans = SpanHash(w)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    start, name = np.arange(n), spans.of(np.arange(n), np.arange(1, n + 1))
    for r, limit in enumerate(LIMITS):
        for pairs in (False, True):
            if len(start) < 2:
                break
            size = np.diff(np.append(start, n))
            small = size <= limit
            can = small[:-1] & small[1:] & ~edge[start[1:]]
            if pairs:
                half = (mix(name + U64(r + 1)) >> U64(63)).astype(bool)
                can &= ~half[:-1] & half[1:]
            else:
                can &= name[:-1] == name[1:]
            start = start[np.append(True, ~can)]
            name = spans.of(start, np.append(start[1:], n))
    return start, name


def lowest(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the (leftmost) smallest ``rank`` in each range [lo, hi), lo < hi."""
    out = np.empty(len(lo), np.int64)
    best = np.arange(len(rank))
    size, step = hi - lo, 1
    while True:
        now = (size >= step) & (size < 2 * step)
        if now.any():
            a, b = best[lo[now]], best[hi[now] - step]
            out[now] = np.where(rank[b] < rank[a], b, a)
        if not (size >= 2 * step).any():
            return out
        two = best[step:]
        one = best[:-step] if step < len(best) else best[:0]
        two = two[:len(one)]
        best = np.append(np.where(rank[two] < rank[one], two, one), best[len(one):])
        step *= 2


def anchors(t: Texts, width: int = WIDTH) -> Columns:
    """The entries of a chunk's documents."""
    w = words(t)
    count = np.diff(w.first)
    doc, p = within(np.maximum(count - width + 1, 0))
    begin = w.first[doc] + p  # every window's first word
    empty = {"key": np.zeros(0, U64), "ctx": np.zeros(0, U64)} | {k: np.zeros(0, np.int64) for k in (
        "text", "start", "n", "rel")}
    if not len(begin):
        return empty
    spans = SpanHash(w.hash)
    start, name = symbols(w.hash, w.first[:-1][count > 0])
    end = np.append(start[1:], len(w.hash))
    lo = np.searchsorted(start, begin + CONTEXT)
    hi = np.searchsorted(end, begin + width - CONTEXT, side="right")
    pick = np.full(len(begin), -1)
    some = lo < hi
    pick[some] = lowest(mix(name + U64(99)), lo[some], hi[some])
    pick[~some] = -1 - begin[~some]  # a long run: the window stands for itself
    new = np.ones(len(begin), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(begin)))
    a, s = begin[at], pick[at]
    found, s = s >= 0, np.maximum(s, 0)
    place = np.where(found, start[s], a)
    lo, hi = np.where(found, place - CONTEXT, a), np.where(found, end[s] + CONTEXT, a + width)
    rel = place - a
    with np.errstate(over="ignore"):
        ctx = mix(spans.of(a, a + n - 1 + width) + rel.astype(U64) * U64(0x9E3779B97F4A7C15))
    return {"key": spans.of(lo, hi), "ctx": ctx, "text": doc[at], "start": p[at], "n": n, "rel": rel}


def _emit(width: int):
    def emit(text: bytes, c: Columns) -> Columns:
        w = words(Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]), slice(0, 1)))
        of, k = within(c["n"])
        start = np.unique(c["start"][of] + k)
        return {"key": SpanHash(w.hash).of(start, start + width),
                "twin": SpanHash(mix(w.hash ^ U64(0x5BF03635))).of(start, start + width), "start": start}
    return emit


def _local(c: Columns) -> tuple[Columns, Columns]:
    c, later = settle(c, ["key", "twin"], strict=True)
    return taken(c, ~later), taken(c, later) | {"n": np.ones(int(later.sum()), np.int32)}


def _resolve(blobs: list[bytes]) -> Columns:
    return _local(unpacked(blobs, WINDOW))[1]


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    carry: list[str] | None = None) -> DataFrame:
    """Remove every word covered by a window that also starts in a document
    with a smaller id.

    Returns ``row`` (the columns in ``carry``), ``n_words``, ``n_removed``,
    ``spans`` (first word and number of words of each removed run),
    ``kept_words`` (the kept words joined by one blank) and ``text`` (the text
    unchanged if nothing goes, else ``kept_words``).
    """
    if width < 2 * CONTEXT + 4 * LIMITS[-1]:
        raise ValueError("a window must hold a symbol with its context")
    how = Repeats(lambda t: anchors(t, width), _emit(width), _local, lambda c, n: dealt(c, "key", WINDOW, n),
                  _resolve, strict=True)
    found = find(keyed_documents(df, id_col, text_col, carry), how)
    schema = T.StructType([found.schema["row"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                           T.StructField("kept_words", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            for t in chunks(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for i in range(len(t)):
                    text = t.of(i)
                    all_words = text.split()
                    kept, runs = all_words, []
                    if s := spans[t.rows.start + i]:
                        c = unpacked(s, SPANS)
                        gone = spans_to_mask(len(all_words), c["start"], c["start"] + c["n"] + width - 1)
                        kept = [w for w, g in zip(all_words, gone) if not g]
                        cut = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                        runs = [[int(a), int(b - a)] for a, b in cut.reshape(-1, 2)]
                    out[0].append(len(all_words))
                    out[1].append(len(all_words) - len(kept))
                    out[2].append(runs)
                    out[3].append(b" ".join(kept).decode())
                    out[4].append(out[3][-1] if runs else text.decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[t.rows], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                     pa.array(out[2], pa.list_(pa.list_(pa.int64()))), pa.array(out[3], pa.string()),
                     pa.array(out[4], pa.string())],
                    ["row", "n_words", "n_removed", "spans", "kept_words", "text"])

    return found.select("row", "text", "spans").mapInArrow(lean(run), schema)
