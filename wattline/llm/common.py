"""Shared helpers of the text operators: fold masks, saved tables, and
vectorised views of Arrow string columns (bytes, words, word hashes)."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.session import checkpoint_dir

U64 = np.uint64
#: Odd multiplier of the polynomial hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 1 << 20

#: Bytes between words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long documents stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


#: Whether shuffle files go when their query has ended; nothing asks for those of a saved table again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and read back (lineage cut)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: A group with more than this share of all rows is met by broadcast: there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 1000


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` with the other columns of ``groups``, which has one row for each
    value of ``keys`` (nulls are equal) and the number ``n`` of its rows.

    Groups with a large share of the rows are few by their definition, so they
    are broadcast; only rows of the others are dealt by key.  Both tables should
    be saved ones, as each is read more than once.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    named = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    heavy, light = named.where(F.col(n) > total * HEAVY), named.where(F.col(n) <= total * HEAVY)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    near = rows.join(F.broadcast(heavy), same)
    rest = rows.join(F.broadcast(heavy), same, "left_anti").join(light.hint("shuffle_hash"), same)
    return near.unionByName(rest).drop(*[f"_g_{k}" for k in keys])


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives freed memory back to the
    system now and then; Python workers live longer than their tasks."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(run(source)):
            yield batch
            if k % 8 == 7:
                release()
        release()

    return batches


def release() -> None:
    """Return unused memory of this process to the system, where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: str | Column, mod: int) -> Column:
    """crc32(id as text) mod ``mod``; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % F.lit(mod)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, folds: int,
                    sample: int) -> DataFrame:
    """``text`` and ``label`` (0 or 1) of labelled documents outside fold 0: the
    ``sample`` ones with the smallest hash of id and text.

    Labels meet the documents' ids before the sample is taken, so labels
    without a document take no place, and rows that share an id and a text
    count once.  An id with several labels has the largest.
    """
    # fixed names, whatever the tables' other columns are called
    lab = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
           .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold("id", folds) != 0))
           .groupBy("id").agg(F.max("label").alias("label")))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    picked = saved(keyed.select("id", "h").join(lab, "id").groupBy("id", "h").agg(F.first("label").alias("label"))
                   .orderBy(F.xxhash64("id", "h"), "id", "h").limit(sample))
    return (keyed.join(F.broadcast(picked), ["id", "h"]).groupBy("id", "h", "label").agg(F.min("text").alias("text"))
            .select("text", "label"))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), element by element."""
    x = np.asarray(x, U64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            p = np.full(size, BASE, U64)
            q = np.full(size, BASE_INV, U64)
            p[0] = q[0] = 1
            p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if n <= 2 * CHUNK_BYTES:
            _powers, _inverse = p, q
        return p[:n], q[:n]
    return _powers[:n], _inverse[:n]


class SpanHash:
    """Hashes of spans [start, end) of a sequence of numbers, from prefix sums.

    Equal spans have equal hashes wherever they lie.  The polynomial is taken
    modulo 2^64 and finalised together with the span's length.
    """

    def __init__(self, values: np.ndarray, seed: int = 0):
        p, self._inv = powers(len(values) + 1)
        with np.errstate(over="ignore"):
            self._sums = np.zeros(len(values) + 1, U64)
            np.cumsum((values.astype(U64) + U64(seed + 1)) * p[:-1], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self._sums[end] - self._sums[start]) * self._inv[start]
            return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """Documents of one chunk: ``data`` holds their UTF-8 bytes end to end,
    document i is data[offsets[i]:offsets[i + 1]]; ``rows`` are their rows in
    the Arrow batch.  Null texts are empty."""

    data: np.ndarray
    offsets: np.ndarray
    rows: slice

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def chunks(batch: pa.RecordBatch | pa.Table, column: str, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of rows with at most ``limit`` bytes of text (or one longer row)."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    _, off, dat = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(dat, np.uint8) if dat is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Texts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], slice(lo, hi))
        lo = hi


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte spans, hashes, and the
    first word of each document (``first`` has one more entry than documents)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


#: Bytes that aren't part of words of letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(t: Texts, seed: int = 0, lower: bool = False, breaks: np.ndarray = WHITE) -> Words:
    """Cut a chunk into words; ``lower`` hashes A-Z as a-z, ``breaks`` says
    which bytes lie between words."""
    data = t.data
    if lower and len(data):
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    n = len(data)
    # a document's end is a break too
    brk = np.zeros(n + 1, bool)
    brk[t.offsets] = True
    ink = ~breaks[data] if n else np.zeros(0, bool)
    before = np.zeros(n, bool)
    before[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~before | brk[:n]))
    after = np.zeros(n, bool)
    after[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~after | brk[1:])) + 1
    h = SpanHash(data, seed).of(start, end) if n else np.zeros(0, U64)
    return Words(start, end, h, np.searchsorted(start, t.offsets))


def within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: the group of each
    element, and its index in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - np.repeat(first, counts)


def spans_to_mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in at least one span [start, end)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:n]) > 0
