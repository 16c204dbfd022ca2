"""Vector code compression: product quantisation in whole numbers.

Each component x becomes floor(1024 * x); a vector is cut into equal parts, and
each part is replaced by the index of the nearest entry of its position's
codebook (squared Euclidean distance, ties to the lower index).  A codebook
starts as that part of the vectors with the smallest ids; each round assigns
every part and replaces each entry by the floor of its parts' mean.

The nearest entry is found by slicing and intersecting: a codebook keeps, for
each dimension, its entries' coordinates in order and, for each place in that
order, a bit mask of the entries before it.  A query's distance to the entries
next to it in single dimensions gives a radius that the nearest entry can't
exceed; the radius cuts a range out of each dimension's order, the range's mask
is the difference of two prefix masks, and the AND over all dimensions leaves
the candidates.  Every entry as near as the radius is among them, so the exact
distances of the candidates alone decide; they are added up some dimensions at a
time, and a candidate already beyond the radius goes.

Tasks add up the sums and counts of their own parts, Spark adds those per entry,
and only the codebooks (``entries`` x dimensions numbers) reach the driver.

Rows whose vector is null, empty, or holds null or non-finite components are
dropped, and so are vectors of another length than that of the smallest id's.
A length that isn't a multiple of ``parts`` is filled up with zeros.  Scaled
components are held within +-2^24 so that sums stay exact.  Rows that share an
id, or have none (nulls come last), are ordered by their components.  With fewer
vectors than ``entries`` the codebooks are smaller; an empty table gives an empty
result.  Other columns travel in ``row`` as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import lean, saved, with_groups

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LIMIT = 1 << 24
#: Vectors handled at once in a task.
BLOCK = 4096
#: Dimensions after which candidates beyond the radius are dropped.
STRIDE = 4


class Codebook:
    """Entries of one part position, with their sliced orders and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        k, d = self.entries.shape
        self.order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, self.order, axis=0)
        words = (k + 63) // 64
        own = np.zeros((k, words), np.uint64)  # each entry's own bit
        own[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.before = np.zeros((d, k + 1, words), np.uint64)
        for j in range(d):
            self.before[j, 1:] = np.bitwise_or.accumulate(own[self.order[:, j]], axis=0)

    def bound(self, q: np.ndarray) -> np.ndarray:
        """A bound on the squared distance to the nearest entry: the least of
        those next to the query in one dimension's order."""
        k, d = self.entries.shape
        best = np.full(len(q), np.iinfo(np.int64).max)
        for j in range(d):
            at = np.minimum(np.searchsorted(self.sorted[:, j], q[:, j]), k - 1)
            np.minimum(best, ((q - self.entries[self.order[at, j]]) ** 2).sum(1), out=best)
        return best

    def candidates(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Bit masks of the entries within ``r`` of the query in every dimension."""
        live = np.full((len(q), self.before.shape[2]), ~np.uint64(0), np.uint64)
        for j in range(q.shape[1]):
            lo = np.searchsorted(self.sorted[:, j], q[:, j] - r, side="left")
            hi = np.searchsorted(self.sorted[:, j], q[:, j] + r, side="right")
            live &= self.before[j][hi] ^ self.before[j][lo]
        return live

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lowest of equals) and squared distance.
        The entry that gave the bound stays to the end, so every query has one."""
        code, dist = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        if not len(q):
            return code, dist
        most = self.bound(q)
        live = self.candidates(q, np.ceil(np.sqrt(most.astype(float))).astype(np.int64) + 1)
        bits = np.unpackbits(live.view(np.uint8).reshape(len(q), -1), axis=1, bitorder="little")[:, :len(self.entries)]
        row, entry = np.nonzero(bits)
        far = np.zeros(len(row), np.int64)
        d = q.shape[1]
        for j in range(d):
            step = q[:, j][row] - self.entries[:, j][entry]
            far += step * step
            if j % STRIDE == STRIDE - 1 and j < d - 1:
                near = np.flatnonzero(far <= most[row])
                row, entry, far = row[near], entry[near], far[near]
        first = np.searchsorted(row, np.arange(len(q) + 1))
        dist = np.minimum.reduceat(far, first[:-1])
        code = np.minimum.reduceat(np.where(far == dist[row], entry, len(self.entries)), first[:-1])
        return code, dist


@dataclass
class Codebooks:
    """The codebooks of all part positions, for vectors of ``dim`` components."""

    dim: int
    books: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def scaled(vectors: pa.Array, dim: int | None, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their scaled vectors (filled up to whole parts).

    Without ``dim`` all kept rows must have one length.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    offs = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values
    bad = np.asarray(values.is_null()) if values.null_count else np.zeros(len(values), bool)
    x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    broken = np.append(0, np.cumsum(bad | ~np.isfinite(x)))
    size = np.diff(offs)
    keep = ~np.asarray(vectors.is_null()) & (size > 0) & (broken[offs[1:]] == broken[offs[:-1]])
    if dim is not None:
        keep &= size == dim
    dim = dim or int(size[keep][0]) if keep.any() else (dim or 0)
    width = -(-dim // parts) * parts
    out = np.zeros((int(keep.sum()), width), np.int64)
    if len(out):
        rows = x[(offs[:-1][keep][:, None] + np.arange(dim)[None, :])]
        out[:, :dim] = np.clip(np.floor(rows * SCALE), -LIMIT, LIMIT).astype(np.int64)
    return np.flatnonzero(keep) if n else np.zeros(0, np.int64), out


def _parts(q: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(q, parts, axis=1)


def start(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", entries: int = ENTRIES,
          parts: int = PARTS) -> Codebooks | None:
    """Codebooks from the vectors with the smallest ids (``entries`` rows reach
    the driver); None without any vector."""
    v = F.col(f"`{vec_col}`")
    # ordinary SQL types compare like their values: nulls and non-finite components first go
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keyed = df.where(ok).select(F.col(f"`{id_col}`").alias("id"), v.cast("array<double>").alias("v"))
    # the smallest id's length is the one that counts
    head = keyed.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not head:
        return None
    dim = len(head[0]["v"])
    ints = F.transform("v", lambda x: F.floor(x * SCALE))
    rows = (keyed.where(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), ints, "v").limit(entries).collect())
    _, q = scaled(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dim, parts)
    return Codebooks(dim, _parts(q, parts))


def improve(df: DataFrame, books: Codebooks, vec_col: str = "embedding") -> Codebooks:
    """One round: assign all parts, then replace each entry by the floor of its
    parts' mean; unused entries stay."""
    parts, width = len(books.books), books.books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books.books]
        count = [np.zeros(len(b), np.int64) for b in books.books]
        total = [np.zeros(b.shape, np.int64) for b in books.books]
        for batch in batches:
            _, q = scaled(batch.column("v"), books.dim, parts)
            for lo in range(0, len(q), BLOCK):
                for p, x in enumerate(_parts(q[lo:lo + BLOCK], parts)):
                    code, _ = made[p].nearest(x)
                    count[p] += np.bincount(code, minlength=len(count[p]))
                    np.add.at(total[p], code, x)
        rows = [(p, int(e), int(count[p][e]), total[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(count[p])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "s"])

    sums = df.select(F.col(f"`{vec_col}`").alias("v")).mapInArrow(lean(run), "part int, entry int, n long, s array<long>")
    per = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    new = [b.copy() for b in books.books]
    for r in per.collect():  # at most entries x parts rows
        new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return Codebooks(books.dim, new)


def train(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", entries: int = ENTRIES,
          parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks | None:
    books = start(df, vec_col, id_col, entries, parts)
    for _ in range(rounds if books else 0):
        books = improve(df, books, vec_col)
    return books


def encode(df: DataFrame, books: Codebooks | None, vec_col: str = "embedding",
           carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``carry``), ``codes`` (0-based indexes, one for each
    part), ``error`` (squared distances added up) of every kept vector."""
    carry = carry or [c for c in df.columns if c != vec_col]
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{vec_col}`").alias("v"))
    schema = T.StructType([src.schema["row"], T.StructField("codes", T.ArrayType(T.IntegerType())),
                           T.StructField("error", T.LongType())])
    if books is None:
        return src.sparkSession.createDataFrame([], schema)
    parts = len(books.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books.books]
        for batch in batches:
            kept, q = scaled(batch.column("v"), books.dim, parts)
            for lo in range(0, len(q), BLOCK):
                found = [made[p].nearest(x) for p, x in enumerate(_parts(q[lo:lo + BLOCK], parts))]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
                n = len(codes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(kept[lo:lo + BLOCK])),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), pa.array(codes.ravel())),
                     pa.array(sum(e for _, e in found))], schema.names)

    return src.mapInArrow(lean(run), schema)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``row`` and the ``vector`` that the codes stand for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books.books])
    flat = F.flatten(F.transform("codes", lambda c, p: F.get(F.get(table, p), c)))
    return coded.select("row", F.transform(F.slice(flat, 1, books.dim), lambda x: x.cast("double") / SCALE).alias("vector"))


def with_label_error(coded: DataFrame, label_field: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the errors added up over the rows of equal
    label, nulls together."""
    coded = saved(coded.withColumn("_l", F.col(f"row.`{label_field}`")))
    sums = saved(coded.groupBy("_l").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    return with_groups(coded, sums, ["_l"], "_n").drop("_l", "_n")
