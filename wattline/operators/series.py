"""Ordered per-key window operators that stay parallel inside one long key.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole key into one
task.  Here every window runs inside bounded time chunks
(``Window.partitionBy(key, chunk)``) and the part that crosses chunks is
carried by a chunk table (one row per chunk) joined back; the chunk table's own
windows are cut into chunks again, ``DEPTH`` times:

* running sums (W1): chunk-local running sum + sum of all earlier chunks;
* preceding rows (W2-W4, W6): every chunk comes with the last n rows before it, so
  previous values are taken in place;
* counts of events in the last rows (W5): a window is the difference of two
  prefix counts, the events up to a row and those that have left its window by
  then, so its length costs nothing.

Rows are counted, not positions, so missing intervals don't matter.

``pos`` deals the rows to chunks; rows are ordered by ``pos`` and ``ties``.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.balance import FAN, bucketed, chunked_rows, group_of, shuffle_partitions, stored

SPAN = 1024
DEPTH = 2


def _chunked(df: DataFrame, pos: str, span: int, name: str) -> DataFrame:
    return df.withColumn(name, F.floor(F.col(pos) / F.lit(span)).cast("long"))


def running_sums(df: DataFrame, keys: Sequence[str], pos: str, cols: dict[str, Column | str],
                 ties: Sequence[str] = (), span: int = SPAN, depth: int = DEPTH) -> DataFrame:
    """Add ``name = sum(expr) over (keys order by pos, ties, up to the current row)``."""
    keys = list(keys)
    d = df.withColumns({f"_v_{n}": (F.col(e) if isinstance(e, str) else e) for n, e in cols.items()})
    if depth == 0:
        w = Window.partitionBy(*keys).orderBy(pos, *ties).rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumns({n: F.sum(f"_v_{n}").over(w) for n in cols}).drop(*[f"_v_{n}" for n in cols])
    ck = f"_ck{depth}"
    d = _chunked(d, pos, span, ck)
    w_local = Window.partitionBy(*keys, ck).orderBy(pos, *ties).rowsBetween(Window.unboundedPreceding, 0)
    totals = d.groupBy(*keys, ck).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in cols])
    upto = running_sums(totals, keys, ck, {f"_r_{n}": f"_t_{n}" for n in cols}, span=span, depth=depth - 1)
    carry = upto.select(*keys, ck, *[(F.col(f"_r_{n}") - F.col(f"_t_{n}")).alias(f"_c_{n}") for n in cols])
    d = d.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(w_local) for n in cols}).join(carry, [*keys, ck])
    d = d.withColumns({n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in cols})
    return d.drop(ck, *[f"_{p}_{n}" for n in cols for p in ("v", "l", "c")])


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _added_up(values: pa.Array, carry: pa.Array) -> pa.Array:
    """For each chunk and column of it the running sums after a carry (a null
    adds nothing; null before a chunk's first number)."""
    values, carry = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (values, carry))
    at, known = values.values.offsets.to_numpy(), np.asarray(values.values.values.is_valid())
    v = np.where(known, values.values.values.to_numpy(zero_copy_only=False).astype(float), 0.0)
    c = carry.values.to_numpy(zero_copy_only=False).astype(float)
    out, unseen = np.empty(len(v)), np.zeros(len(v), bool)
    for k, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
        out[lo:hi] = np.cumsum(v[lo:hi]) + c[k]
        if not known[lo:hi].all():
            unseen[lo:hi] = np.cumsum(known[lo:hi]) == 0
    inner = pa.ListArray.from_arrays(values.values.offsets, pa.array(out, mask=unseen))
    return pa.ListArray.from_arrays(values.offsets, inner)


def chunk_sums(df: DataFrame, keys: Sequence[str], position: Column, order: Sequence[str], cols: dict[str, Column],
               span: int = SPAN) -> DataFrame:
    """``running_sums`` of numbers over rows that are costly to make: their chunks
    are stored once with their totals, so the carries don't make the rows again."""
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    row = F.struct(*order, *[c for c in payload if c not in order], *[e.cast("double").alias(f"_v_{n}") for n, e in cols.items()])
    total = lambda n: F.aggregate(f"_rows._v_{n}", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    blocks = bucketed(chunked_rows(df, keys, position, row, span).select("*", *[total(n).alias(f"_t_{n}") for n in cols]),
                      [*keys, "_c"], "sums")
    upto = running_sums(blocks.drop("_rows"), keys, "_c", {f"_r_{n}": f"_t_{n}" for n in cols}, depth=1)
    carry = upto.select(*keys, "_c", F.array(*[F.col(f"_r_{n}") - F.col(f"_t_{n}") for n in cols]).alias("_carry"))
    sums = _added_up(F.array(*[F.col(f"_rows._v_{n}") for n in cols]), F.col("_carry"))
    z = blocks.select(*keys, "_c", "_rows").join(carry.hint("shuffle_hash"), [*keys, "_c"]).withColumn("_sums", sums).select(*keys, F.inline(F.arrays_zip(
        F.col("_rows").alias("r"), *[F.col("_sums")[i].alias(n) for i, n in enumerate(cols)])))
    return z.select(*keys, *[F.col(f"r.{c}").alias(c) for c in payload], *cols)


def with_preceding(df: DataFrame, keys: Sequence[str], position: Column, order: Sequence[str], n: int,
                   fields: Sequence[str]) -> DataFrame:
    """keys, _rows, _tail: the rows of each time chunk in order, and ``fields``
    of the last ``n`` rows of the key before it (fewer at the key's start)."""
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    row = F.struct(*order, *[c for c in payload if c not in order])
    blocks = chunked_rows(df, keys, position, row)
    pick = lambda r: F.struct(*[r[f].alias(f) for f in fields])
    ends = blocks.select(*keys, "_c", F.transform(_last(F.col("_rows"), n), pick).alias("_tail"))
    return blocks.join(_tails(ends, keys, n, 1).hint("shuffle_hash"), [*keys, "_c"])


def _last(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), n)


def _tails(ends: DataFrame, keys: list[str], n: int, depth: int) -> DataFrame:
    """keys, _c, _tail: the last ``n`` rows before each chunk, from each chunk's
    own last rows (``ends``); chunks are looked at in groups of FAN."""
    group = keys if depth == 0 else [*keys, "_b"]
    d = ends if depth == 0 else ends.withColumn("_b", group_of("_c"))
    g = d.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_c", "_tail"))).alias("_e"))
    own = F.transform("_e", lambda x: x["_tail"])
    if depth == 0:
        opened = g.withColumn("_open", F.slice(F.element_at(own, 1), 1, 0))
    else:
        # a chunk has a row at least, so n rows lie in the last n chunks
        above = g.select(*keys, F.col("_b").alias("_c"), _last(F.flatten(_last(own, n)), n).alias("_tail"))
        opened = g.join(_tails(above, keys, n, depth - 1).select(*keys, F.col("_c").alias("_b"), F.col("_tail").alias("_open")),
                        group)
    before = F.transform("_e", lambda x, i: F.struct(x["_c"].alias("_c"), _last(F.concat(
        F.col("_open"), F.flatten(_last(F.slice(own, 1, i), n))), n).alias("_tail")))
    return opened.select(*keys, F.inline(before))


def preceding(ends: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """keys, _c, _tail: the last ``n`` rows before each chunk, from each chunk's
    own last rows (keys, _c, _tail)."""
    return _tails(ends, list(keys), n, 1)


def events(flag: str, rows: str = "_rows") -> Column:
    """Places (from 0) of a chunk's rows in which ``flag`` is positive."""
    at = F.transform(rows, lambda r, i: F.when(r[flag] > 0, i))
    return F.filter(at, lambda i: i.isNotNull())


def window_starts(chunks: DataFrame, keys: Sequence[str], kinds: dict[str, str], span: int = SPAN) -> DataFrame:
    """What a chunk needs to count the events in its rows' windows: keys, _c, and
    for each kind a struct of that name: ``first`` (rows of the key before the
    chunk), ``alive`` (events still in the window of the row before the chunk,
    plus those that leave in the bucket before its first row), ``gone`` (row numbers
    at which events leave).

    ``chunks`` has keys, _c, n (rows) and for each kind an array of event
    places; ``kinds`` maps the kind to the column with its window's length (0:
    no window, no events are looked at).  An event in row s leaves the window in row s +
    length; these row numbers are dealt to buckets of ``span`` rows and met by the
    chunks that overlap them, so neither a long window nor a long key gathers
    anywhere.
    """
    keys = list(keys)
    c = F.col
    long = chunks.select(*keys, "_c", "n", F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.when(c(w) > 0, c(k)).otherwise(F.slice(c(k), 1, 0)).alias("at"),
                 c(w).cast("long").alias("length")) for k, w in kinds.items()])))
    part = [*keys, "kind"]
    d = running_sums(long.withColumn("m", F.size("at").cast("long")), part, "_c", {"_rows_to": "n", "_events_to": "m"}, span=FAN, depth=1)
    d = d.select(*part, "_c", "n", "length", "at", (c("_rows_to") - c("n")).alias("first"),
                 (c("_events_to") - c("m")).alias("seen"))
    leave = d.select(*part, F.explode("at").alias("i"), "first", "length").select(
        *part, (c("first") + c("i") + c("length")).alias("r")).withColumn("b", F.floor(c("r") / span).cast("long"))
    met = d.select(*part, "_c", F.explode(F.sequence(F.floor(c("first") / span), F.floor((c("first") + c("n") - 1) / span)))
                   .alias("b")).withColumn("b", c("b").cast("long"))
    # every bucket that a chunk overlaps, with the events that leave in it, and before it
    filled = (leave.select(*part, "b", "r").unionByName(met.select(*part, "b").withColumn("r", F.lit(None).cast("long")))
              .groupBy(*part, "b").agg(F.array_sort(F.collect_list("r")).alias("gone")))
    filled = running_sums(filled.withColumn("m", F.size("gone").cast("long")), part, "b", {"_left_to": "m"}, span=FAN, depth=1)
    near = met.join(filled.select(*part, "b", "gone", (c("_left_to") - c("m")).alias("left")), [*part, "b"])
    per = near.groupBy(*part, "_c").agg(F.min("left").alias("left"),
                                        F.array_sort(F.flatten(F.collect_list("gone"))).alias("gone"))
    one = d.select(*part, "_c", "first", "seen").join(per, [*part, "_c"]).select(
        *part, "_c", F.struct("first", (c("seen") - c("left")).alias("alive"), "gone").alias("w"))
    return one.groupBy(*keys, "_c").agg(*[F.first(F.when(c("kind") == k, c("w")), ignorenulls=True).alias(k) for k in kinds])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def window_counts(flags: pa.Array, window: pa.Array) -> pa.Array:
    """For each row of a chunk the events in its window, itself included, from
    the chunk's flags and what ``window_starts`` found."""
    flags, window = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (flags, window))
    offs, f = flags.offsets.to_numpy(), flags.values.to_numpy(zero_copy_only=False)
    first, alive = (window.field(c).to_numpy(zero_copy_only=False) for c in ("first", "alive"))
    gone = window.field("gone")
    at, left = gone.offsets.to_numpy(), gone.values.to_numpy(zero_copy_only=False)
    out = np.empty(offs[-1] - offs[0])
    for k, (lo, hi) in enumerate(zip(offs[:-1], offs[1:])):
        rows = first[k] + np.arange(hi - lo)
        out[lo - offs[0]:hi - offs[0]] = (alive[k] + np.cumsum(f[lo:hi] > 0)
                                          - np.searchsorted(left[at[k]:at[k + 1]], rows, side="right"))
    return pa.ListArray.from_arrays(pa.array((offs - offs[0]).astype(np.int32)), pa.array(out))


def ranged(df: DataFrame, part: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """The rows in ranges of (part, order), stored once: ``_p`` is a row's range.

    Ranges come from a sample of the keys, so a very large part spreads over
    many and small ones share one; the table keeps each row in the range it
    was dealt to, whatever is lost or read again.
    """
    n = shuffle_partitions(df)
    return stored(df.repartitionByRange(n, *[F.col(p) for p in part], *order).withColumn("_p", F.spark_partition_id()), name)


def row_numbers(rows: DataFrame, part: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``row_number`` of each part over rows of ``ranged``: the place in the range,
    and the numbers of rows in the part's ranges before."""
    part = list(part)
    counts = rows.groupBy(*part, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*part, "_p").orderBy(*order)))
    return local.join(carry, [*part, "_p"]).withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop(
        "_local", "_before")
