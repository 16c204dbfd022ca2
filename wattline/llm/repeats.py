"""Windows of fixed length that also occur earlier: the part that the substring
operators share.

A window is ``width`` consecutive units (words or bytes) of one document.  An
operator cuts the documents into *anchors*: for every window it picks one place
inside it by a rule that looks at nothing but the window's own content, so
equal windows pick the same place.  Windows that follow each other and pick the
same place form one entry

    key    a hash of content around the place that every such window contains
    ctx    a hash of all units of the entry's windows and where the place lies
    doc, ver, alt, start, n    the document, and the first and number of its windows

Equal windows have equal keys, and entries of equal (key, ctx) hold equal
windows.  Entries meet by key in Spark: the first of each (key, ctx) stays, the
others are repeats as a whole.  Tasks do this among their own entries before
the shuffle, so a passage copied into a third of all rows sends one entry per
task.  A key left with several contexts (the ends of repeats, nearby edits)
needs a look at its windows one by one; the operator does that in its
``verify`` step, from the texts of those documents only.

What is found out about documents goes to buckets of documents, packed like the
entries: a row for each document and bucket of keys would grow with the number of
buckets, up to a row for each entry.

``strict`` says whether an earlier window must lie in a document with a smaller
id (True), or may lie in the same document before (False).

A document is known by its id and two 64-bit hashes of its text (``ver``, ``alt``),
so rows that share an id don't mix; a null id sorts before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import Texts, chunks, lean, mix, partitions, saved

NULL_ID = -(1 << 63)
#: What the second hash of a text begins with.
SALT = 0x5851F42D4C957F2D
#: Entries a task gathers before it settles them and hands them on.
GATHER = 1 << 18
#: A key with more contexts than this is split further before it is verified.
CROWD = 1024

#: What a document is known by.
DOC = ["doc", "ver", "alt"]
#: Columns of an entry, end to end in one binary value.
ME = [("doc", "i8"), ("ver", "i8"), ("alt", "i8")]
ENTRY = [("key", "u8"), ("ctx", "u8"), *ME, ("start", "i4"), ("n", "i4"), ("rel", "i4")]
SPANS = [("start", "i4"), ("n", "i4")]
OPEN = [("start", "i4"), ("n", "i4"), ("rel", "i4"), ("crowd", "i4"), ("key", "u8")]

Columns = dict[str, np.ndarray]


def packed(c: Columns, layout: list[tuple[str, str]], pick: np.ndarray | slice = slice(None)) -> bytes:
    return b"".join([np.ascontiguousarray(c[name][pick]).astype(f"<{kind}", copy=False).tobytes()
                     for name, kind in layout])


def unpacked(blobs: list[bytes], layout: list[tuple[str, str]]) -> Columns:
    width = sum(int(kind[1]) for _, kind in layout)
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in layout}
    for b in blobs:
        n, at = len(b) // width, 0
        for name, kind in layout:
            parts[name].append(np.frombuffer(b, f"<{kind}", n, at))
            at += n * int(kind[1])
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, kind) for name, kind in layout}


def joined(parts: list[Columns]) -> Columns:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def taken(c: Columns, pick: np.ndarray) -> Columns:
    return {k: v[pick] for k, v in c.items()}


def settle(c: Columns, by: list[str], strict: bool) -> tuple[Columns, np.ndarray]:
    """Sort by ``by``, document and start; and which rows come after the first
    of their group (in a later document, if ``strict``)."""
    order = np.lexsort([c["start"], c["doc"], *[c[k] for k in reversed(by)]])
    c = taken(c, order)
    n = len(order)
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in by:
            new[1:] |= c[k][1:] != c[k][:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = c["doc"] > c["doc"][first]
    if not strict:
        later |= (c["doc"] == c["doc"][first]) & (c["start"] > c["start"][first])
    return c, later


def by_document(c: Columns, layout: list[tuple[str, str]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(doc, ver, alt, packed rows) for each document in ``c``."""
    order = np.lexsort([c["start"], c["alt"], c["ver"], c["doc"]])
    c = taken(c, order)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[k][1:] != c[k][:-1] for k in DOC], axis=0)
    at = np.append(np.flatnonzero(new), len(order))
    for lo, hi in zip(at[:-1], at[1:]):
        yield *(int(c[k][lo]) for k in DOC), packed(c, layout, slice(lo, hi))


def runs(c: Columns) -> Columns:
    """Spans in order of their documents; those of a document that meet or overlap are one."""
    c = taken(c, np.lexsort([c["start"], *[c[k] for k in reversed(DOC)]]))
    if not len(c["start"]):
        return c
    end = c["start"].astype(np.int64) + c["n"]
    new = np.append(True, np.any([c[k][1:] != c[k][:-1] for k in DOC], axis=0) | (c["start"][1:] > end[:-1]))
    first = np.flatnonzero(new)
    out = taken({k: c[k] for k in (*DOC, "start")}, first)
    return out | {"n": np.maximum.reduceat(end, first) - out["start"]}


def to_documents(kind: int, c: Columns, layout: list[tuple[str, str]], buckets: int) -> list[tuple]:
    """Message rows that carry ``c`` to the buckets of its documents, in their order."""
    at = bucket_of(mix(mix(c["doc"].astype(np.uint64)) ^ c["ver"].astype(np.uint64)), buckets)
    order = np.lexsort([c["start"], *[c[k] for k in reversed(DOC)], at])
    at = at[order]
    cut = np.searchsorted(at, np.arange(buckets + 1))
    return [(kind, k, 0, 0, 0, packed(c, [*ME, *layout], order[cut[k]:cut[k + 1]])) for k in range(buckets) if cut[k] < cut[k + 1]]


# rows between the steps: 0 entries for a bucket of keys; for a bucket of documents, 1 repeats, 2 open entries
MESSAGE = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()),
                        *[T.StructField(k, T.LongType()) for k in DOC], T.StructField("data", T.BinaryType())])
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *[(k, pa.int64()) for k in DOC], ("data", pa.binary())])


def messages(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of message rows, of a few MB each."""
    lo = 0
    while lo < len(rows):
        hi, size = lo, 0
        while hi < len(rows) and size < 8 << 20 and hi - lo < 10_000:
            size += len(rows[hi][-1])
            hi += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[lo:hi]], f.type) for k, f in enumerate(_ARROW)],
                                         schema=_ARROW)
        lo = hi


def dealt(c: Columns, by: str, layout: list[tuple[str, str]], buckets: int) -> list[tuple]:
    """Message rows that carry ``c`` to buckets by a hash of ``by``; in
    order of documents, which compresses best."""
    at = bucket_of(mix(c[by]), buckets)
    order = np.lexsort([c["start"], c["doc"], at])
    cut = np.searchsorted(at[order], np.arange(buckets + 1))
    return [(0, k, 0, 0, 0, packed(c, layout, order[cut[k]:cut[k + 1]])) for k in range(buckets) if cut[k] < cut[k + 1]]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def keyed_documents(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None) -> DataFrame:
    """doc, ver, alt, text, and the columns in ``carry`` as a struct ``row``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc"),
                     F.xxhash64(text).alias("ver"), F.xxhash64(F.lit(SALT), text).alias("alt"), text.alias("text"),
                     F.struct(*[F.col(f"`{c}`") for c in (carry or [id_col])]).alias("row"))


def anchor_entries(docs: DataFrame, anchors: Callable[[Texts], Columns], strict: bool) -> DataFrame:
    """Message rows of all documents: entries, and what a task could settle.

    ``anchors`` gives key, ctx, text (index in the chunk), start, n, rel.
    """
    buckets = partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Columns] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            c, later = settle(joined(parts), ["key", "ctx"], strict)
            rows = dealt(taken(c, ~later), "key", ENTRY, buckets)
            rows += to_documents(1, runs(taken(c, later)), SPANS, buckets)
            yield from messages(rows)

        for batch in batches:
            me = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in DOC}
            for t in chunks(batch, "text"):
                c = anchors(t)
                of = c.pop("text")
                c |= {k: v[t.rows][of] for k, v in me.items()}
                parts.append(c)
                held += len(of)
                if held > GATHER:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    return docs.select(*DOC, "text").mapInArrow(lean(run), MESSAGE)


def settle_entries(entries: DataFrame, strict: bool) -> DataFrame:
    """Bring entries together by key: repeats (kind 1) and open entries (2)."""
    n = partitions(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == 1).any():
                yield batch.filter(pa.array(kind == 1))
            blobs += batch.column("data").filter(pa.array(kind == 0)).to_pylist()
        c, later = settle(unpacked(blobs, ENTRY), ["key", "ctx"], strict)
        del blobs
        if not len(later):
            return
        yield from messages(to_documents(1, runs(taken(c, later)), SPANS, n))
        c = taken(c, ~later)
        new = np.append(True, c["key"][1:] != c["key"][:-1])
        group = np.cumsum(new) - 1
        fresh = new | np.append(True, c["ctx"][1:] != c["ctx"][:-1])
        contexts = np.bincount(group, fresh)
        open_ = contexts[group] > 1
        if strict:  # a key of one document alone repeats nothing
            first = c["doc"][np.flatnonzero(new)]
            open_ &= (np.bincount(group, c["doc"] != first[group]) > 0)[group]
        c["crowd"] = contexts[group].astype(np.int32)
        yield from messages(to_documents(2, taken(c, open_), OPEN, n))

    return entries.repartitionById(n, F.col("bucket")).mapInArrow(lean(run), MESSAGE)


def of_documents(rows: DataFrame, layout: list[tuple[str, str]], name: str) -> DataFrame:
    """A row for each document: DOC, and its packed rows as the only element of the list ``name``;
    from message rows for buckets of documents."""
    schema = T.StructType([*[T.StructField(k, T.LongType()) for k in DOC], T.StructField(name, T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = unpacked([b for batch in batches for b in batch.column("data").to_pylist()], [*ME, *layout])
        if not len(c["doc"]):
            return
        for batch in messages([(0, 0, *r) for r in by_document(runs(c) if layout is SPANS else c, layout)]):
            data = batch.column("data")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1), pa.int32()), data)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in DOC], lists], names=[*DOC, name])

    return rows.select("bucket", "data").repartitionById(partitions(rows.sparkSession), F.col("bucket")).mapInArrow(lean(run), schema)


@dataclass
class Repeats:
    """How an operator finds repeats: its anchors, and how it verifies open
    entries.  ``emit`` makes columns of what an open document sends; ``local``
    parts them into those to send and repeats (doc, ver, alt, start, n) that show in
    the task itself; ``send`` deals them to buckets as message rows; ``resolve``
    finds the repeats among a bucket's blobs."""

    anchors: Callable[[Texts], Columns]
    emit: Callable[[bytes, Columns], Columns]
    local: Callable[[Columns], tuple[Columns, Columns]]
    send: Callable[[Columns, int], list[tuple]]
    resolve: Callable[[list[bytes]], Columns]
    strict: bool


def find(docs: DataFrame, how: Repeats) -> DataFrame:
    """``docs`` (of keyed_documents) with ``spans``: the packed (start, n) runs
    of windows that occur earlier, or null."""
    n = partitions(docs.sparkSession)
    told = saved(settle_entries(anchor_entries(docs, how.anchors, how.strict), how.strict))
    # a table too: their exchange is gone before the documents are dealt out
    known = saved(of_documents(told.where("kind = 1"), SPANS, "spans"))
    need = of_documents(told.where("kind = 2"), OPEN, "open")
    # the row goes along so that both joins read the documents by one exchange
    todo = docs.join(need.hint("shuffle_hash"), DOC).select(*DOC, "text", "row", "open")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Columns] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keep, repeats = how.local(joined(parts))
            yield from messages(how.send(keep, n))
            yield from messages(to_documents(1, runs(repeats), SPANS, n))

        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in (*DOC, "open")])
            texts = (t.of(i) for t in chunks(batch, "text") for i in range(len(t)))
            for (*me, blobs), text in zip(rows, texts):
                c = how.emit(text, unpacked(blobs, OPEN))
                c |= {k: np.full(len(c["key"]), v) for k, v in zip(DOC, me)}
                parts.append(c)
                held += len(c["key"])
                if held > GATHER:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == 1).any():
                yield batch.filter(pa.array(kind == 1))
            blobs += batch.column("data").filter(pa.array(kind == 0)).to_pylist()
        if blobs:
            yield from messages(to_documents(1, runs(how.resolve(blobs)), SPANS, n))

    more = todo.mapInArrow(lean(emit), MESSAGE).repartitionById(n, F.col("bucket")).mapInArrow(lean(resolve), MESSAGE)
    spans = known.unionByName(of_documents(more, SPANS, "spans")).groupBy(*DOC).agg(
        F.flatten(F.collect_list("spans")).alias("spans"))
    return docs.join(spans.hint("shuffle_hash"), DOC, "left")
