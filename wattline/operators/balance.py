"""Bounded running balance (state of charge) as a parallel scan.

For every key, in time order::

    s_t = min(hi_t, max(lo_t, s_{t-1} + a_t)),   s_0 = init

No window frame computes this.  Each step is the clamp function
``f(s) = min(hi, max(lo, s + a))`` and clamps compose into clamps, so the
balance is a prefix scan over an associative operator.  There is one plan for
every key length:

1. Spark deals the rows by (key, time chunk) and collects each chunk as one
   array in time order (one exchange of the rows).
2. Each chunk that opens another one (not the last of its key) is composed into
   one clamp; the other rows are not collected for that.
3. The chunks' clamps of a key, one row per ``SPAN`` steps, are scanned the
   same way (in groups of ``FAN`` chunks, and those per key) for every chunk's
   opening balance.
4. The opening balance is joined back to its chunk, which is folded step by
   step and laid out again as one row per input row.

A long key is therefore spread over many tasks.  Nothing depends on the data
when the plan is built.  A chunk in which some clamp binds (L = H) gives the
next one its opening balance by the very operations of a sequential loop;
otherwise the composition may differ from it in the last bits.

Rows of a chunk are ordered by ``order`` and then by all their other values,
so equal times give the same result in any file order.  The fold also hands
out values of the previous row (``lagged``) and the balance before it
(``prev2_out``), so what depends on the previous row needs no exchange.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.session import checkpoint_dir

SPAN = 2048    # steps of a chunk
FAN = 2048     # chunks of a group

_D = T.DoubleType()
_CLAMPS = T.StructType([T.StructField(n, _D) for n in ("fa", "flo", "fhi", "ga", "glo", "ghi")])
_STATES = T.ArrayType(T.StructType([T.StructField(n, _D) for n in ("s0", "s", "sp")]))
_OPENINGS = T.ArrayType(T.StructType([T.StructField(n, _D) for n in ("s_in", "s_prev")]))
_INF = float("inf")


def lists_of(arr: pa.Array, fields: Sequence[str]):
    """For each list of structs, its fields as Python lists."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offs = arr.offsets.to_pylist()
    vals = arr.values
    cols = [vals.field(f) for f in fields]
    for lo, hi in zip(offs[:-1], offs[1:]):
        yield [c.slice(lo, hi - lo).to_pylist() for c in cols]


def matrices(arr: pa.Array, fields: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of lists of structs, and each field as a matrix: a list in each
    column, zeros after its end.  A step of all lists is then one vector."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offs = arr.offsets.to_numpy()
    n = np.diff(offs)
    inside = np.arange(int(n.max()) if len(n) else 0)[:, None] < n
    out = []
    for f in fields:
        m = np.zeros(inside.T.shape)
        m[inside.T] = arr.values.field(f).to_numpy(zero_copy_only=False)[offs[0]:offs[-1]]
        out.append(np.ascontiguousarray(m.T))
    return n, out


def laid_out(n: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Array:
    """Matrices back as lists of structs (NaN: null)."""
    inside = (np.arange(int(n.max()) if len(n) else 0)[:, None] < n).T
    vals = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(m.T)[inside], from_pandas=True) for m in columns.values()],
                                      names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), vals)


def _then(f: tuple, g: tuple) -> tuple:
    """The clamp that applies ``f``, then ``g``."""
    (a, lo, hi), (b, l, h) = f, g
    c = lambda x: min(h, max(l, x))
    return a + b, c(lo + b), c(hi + b)


@F.arrow_udf(_CLAMPS)
def _compose_chunk(steps: pa.Array) -> pa.Array:
    """The steps of each chunk as one clamp, and as one without the last."""
    n, (a, lo, hi) = matrices(steps, ("a", "lo", "hi"))
    add, low, high = np.zeros(len(n)), np.full(len(n), -_INF), np.full(len(n), _INF)
    out = np.zeros((6, len(n)))
    ends = set(n.tolist())
    for t in range(len(a)):
        if t + 1 in ends:
            at = n == t + 1
            out[3:, at] = add[at], low[at], high[at]
        # the limits of clamped values are clamped by every step, so steps after a chunk's end must not touch them
        live = n > t
        add = add + a[t]
        low = np.where(live, np.minimum(np.maximum(low + a[t], lo[t]), hi[t]), low)
        high = np.where(live, np.minimum(np.maximum(high + a[t], lo[t]), hi[t]), high)
    out[:3] = add, low, high
    return pa.StructArray.from_arrays([pa.array(c) for c in out], names=_CLAMPS.names)


@F.arrow_udf(_CLAMPS)
def _compose_group(clamps: pa.Array) -> pa.Array:
    out = []
    for cols in lists_of(clamps, _CLAMPS.names):
        f, g = (0.0, -_INF, _INF), (0.0, -_INF, _INF)
        for fa, fl, fh, ga, gl, gh in zip(*cols):
            if fa is None:  # a chunk that opens no other need not be composed
                continue
            g = _then(f, (ga, gl, gh))
            f = _then(f, (fa, fl, fh))
        out.append((*f, *g))
    cols = list(zip(*out)) or [[]] * 6
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in cols], names=_CLAMPS.names)


@F.arrow_udf(_OPENINGS)
def _fold_group(s_in: pa.Array, s_prev: pa.Array, clamps: pa.Array) -> pa.Array:
    """For each element: the balance before it, and before the row before it."""
    out = []
    for s, sp, cols in zip(s_in.to_pylist(), s_prev.to_pylist(), lists_of(clamps, _CLAMPS.names)):
        rows = []
        for fa, fl, fh, ga, gl, gh in zip(*cols):
            rows.append({"s_in": s, "s_prev": sp})
            if fa is not None:
                s, sp = min(fh, max(fl, s + fa)), min(gh, max(gl, s + ga))
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("s_in", pa.float64()), ("s_prev", pa.float64())])))


@F.arrow_udf(_STATES)
def _fold_chunk(s_in: pa.Array, s_prev: pa.Array, steps: pa.Array) -> pa.Array:
    """Balance before, after, and before the previous step, of every step."""
    n, (a, lo, hi) = matrices(steps, ("a", "lo", "hi"))
    s = s_in.to_numpy(zero_copy_only=False).astype(float)
    before = np.empty((len(a) + 1, len(n)))
    before[0] = s
    for t in range(len(a)):
        s = np.minimum(np.maximum(s + a[t], lo[t]), hi[t])
        before[t + 1] = s
    first = s_prev.to_numpy(zero_copy_only=False).astype(float)[None, :]
    return laid_out(n, {"s0": before[:-1], "s": before[1:], "sp": np.vstack([first, before[:-2]]) if len(a) else a})


def shuffle_partitions(df: DataFrame) -> int:
    """The session's shuffle partition count, the cluster's sizing knob."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def chunked_rows(df: DataFrame, keys: Sequence[str], position: Column, row: Column, span: int = SPAN,
                 constant: Sequence[str] = ()) -> DataFrame:
    """keys, _c, _rows: the rows of each time chunk as one sorted array.

    The rows are dealt by (key, chunk) over the session's partition count, so
    the Python stage that follows isn't folded into a few tasks, and a key's
    chunks go to different tasks.  (``sort_array`` compares in place; ``array_sort``
    evaluates an expression for every comparison.)  ``constant`` are columns that are the same in all rows of a key; they are
    kept once for a chunk.
    """
    return _by_chunk(df, keys, position, span).groupBy(*keys, "_c").agg(
        F.sort_array(F.collect_list(row)).alias("_rows"), *[F.first(c).alias(c) for c in constant])


def _by_chunk(df: DataFrame, keys: Sequence[str], position: Column, span: int) -> DataFrame:
    d = known(df.withColumn("_c", F.floor(position / F.lit(span)).cast("long")), [*keys, "_c"])
    return d.repartition(shuffle_partitions(df), *keys, "_c")


def next_chunks(df: DataFrame, keys: Sequence[str], position: Column, row: Column, span: int = SPAN) -> DataFrame:
    """The chunks that open another one: keys, _c, _nc (the next chunk) and _nl (the
    next is the key's last).

    The rows' hash makes this read all that ``chunked_rows`` reads, so both
    read one exchange.
    """
    chunks = _by_chunk(df, keys, position, span).groupBy(*keys, "_c").agg(F.max(F.xxhash64(row)).alias("_h"))
    by = Window.partitionBy(*keys).orderBy("_c")
    return chunks.where(F.col("_h").isNotNull()).select(
        *keys, "_c", F.lead("_c").over(by).alias("_nc"), F.lead("_c", 2).over(by).isNull().alias("_nl")).where(
            F.col("_nc").isNotNull())


def opening_chunks(df: DataFrame, nexts: DataFrame, keys: Sequence[str], position: Column, row: Column,
                   span: int = SPAN) -> DataFrame:
    """``chunked_rows`` of the chunks in ``nexts``, with its _nc and _nl; a key's last
    chunk opens no other and need not be composed."""
    d = _by_chunk(df, keys, position, span).join(nexts.hint("shuffle_hash"), [*keys, "_c"])
    return d.groupBy(*keys, "_c", "_nc", "_nl").agg(F.sort_array(F.collect_list(row)).alias("_rows"))


def with_ends(composed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Composed chunks (keys, _c, _nc, _nl, _f, _last) as ``openings`` takes them: with
    the last chunk of each of their keys, which has no function."""
    none = lambda c: F.lit(None).cast(composed.schema[c].dataType).alias(c)
    end = F.struct(F.when(F.col("_nl"), F.col("_nc")).alias("_c"), none("_f"), none("_last"))
    return composed.select(*keys, F.inline(F.array(F.struct("_c", "_f", "_last"), end))).where(F.col("_c").isNotNull())


def known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not null.

    A join by these keys drops the others anyway, but lets its own side know
    only; with the filter here all readers of an exchange ask for the same rows,
    and Spark runs it once.
    """
    return df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))


def group_of(chunk: str, fan: int = FAN) -> Column:
    """The group of a chunk (never null, see ``chunked_rows``).

    Said so that Spark sees it: a filter on it would go down to the rows of one
    reader of their exchange, and the rows would be made once more for that one.
    """
    return F.coalesce(F.floor(F.col(chunk) / F.lit(fan)).cast("long"), F.lit(0).cast("long"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/wattline_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Store a table once in the shared folder, bucketed by ``keys`` as ``df``
    is dealt: joins on them read it without an exchange."""
    spark = df.sparkSession
    name = f"wattline_{name}_{uuid.uuid4().hex}"
    (df.write.bucketBy(shuffle_partitions(df), *keys).option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}")
     .option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def shifted(first: Column, arr: Column) -> Column:
    """An array moved by one: ``first``, then all elements but the last."""
    return F.concat(F.array(first), F.slice(arr, 1, F.size(arr) - 1))


def openings(chunks: DataFrame, keys: Sequence[str], *, compose: Callable, fold: Callable, init: Column,
             init_prev: Column, last_type: T.DataType, fan: int = FAN, depth: int = 1) -> DataFrame:
    """The state with which each chunk opens, of the keys with several chunks.

    ``chunks`` has keys, _c, _f (the chunk's function) and _last (values of its
    last row), both null in a key's last chunk.  Returns keys, _c, s_in, s_prev (the state before the previous
    row) and _before (values of the previous row).
    """
    keys = list(keys)
    e = F.struct("_c", "_f", "_last")
    group = keys if depth == 0 else [*keys, "_b"]
    d = chunks if depth == 0 else chunks.withColumn("_b", group_of("_c", fan))
    groups = d.groupBy(*group).agg(F.sort_array(F.collect_list(e)).alias("_e"))
    functions = F.transform("_e", lambda x: x["_f"])
    if depth == 0:
        opened = groups.withColumns({"_si": init, "_sp": init_prev, "_bf": F.lit(None).cast(last_type)})
    else:
        above = groups.select(*keys, F.col("_b").alias("_c"), compose(functions).alias("_f"),
                              F.element_at("_e", -1)["_last"].alias("_last"))
        up = openings(above, keys, compose=compose, fold=fold, init=init, init_prev=init_prev, last_type=last_type,
                      fan=fan, depth=depth - 1)
        opened = groups.join(up.select(*keys, F.col("_c").alias("_b"), F.col("s_in").alias("_si"),
                                       F.col("s_prev").alias("_sp"), F.col("_before").alias("_bf")), group)
    before = shifted(F.col("_bf"), F.transform("_e", lambda x: x["_last"]))
    z = opened.select(*keys, F.inline(F.arrays_zip(F.col("_e").alias("e"), fold(F.col("_si"), F.col("_sp"), functions)
                                                   .alias("s"), before.alias("b"))))
    return z.select(*keys, F.col("e._c").alias("_c"), F.col("s.s_in").alias("s_in"), F.col("s.s_prev").alias("s_prev"),
                    F.col("b").alias("_before"))


def shared_nexts(nexts: list[DataFrame] | None, *of) -> DataFrame:
    """The table in ``nexts``, or ``next_chunks`` of these rows, which it then takes."""
    if nexts:
        return nexts[0]
    found = next_chunks(*of)
    if nexts is not None:
        nexts.append(found)
    return found


def clamp_openings(chunks: DataFrame, keys: Sequence[str], last_type: T.DataType, init: float = 0.0,
                   fan: int = FAN) -> DataFrame:
    """``openings`` for clamps."""
    return openings(chunks, keys, compose=_compose_group, fold=_fold_group, init=F.lit(float(init)),
                    init_prev=F.lit(None).cast("double"), last_type=last_type, fan=fan)


def bounded_balance(df: DataFrame, keys: Sequence[str], position: Column | str, step: Column | str,
                    lo: Column | str | float, hi: Column | str | float, *, order: Sequence[str] = (), out: str = "soc",
                    prev_out: str | None = "soc_prev", prev2_out: str | None = None,
                    lagged: dict[str, Column] | None = None, init: float = 0.0, span: int = SPAN,
                    fan: int = FAN, nexts: list[DataFrame] | None = None) -> DataFrame:
    """Append the bounded running balance of ``step`` per key in time order.

    ``position`` is a long that doesn't fall with time (the interval index); it
    only deals rows to chunks.  ``order`` are the columns that order the rows
    (default: the position).  ``lo`` / ``hi`` may vary by row (lo <= hi).
    ``out`` is the balance after the row's step, ``prev_out`` before it,
    ``prev2_out`` before the previous row's step; ``lagged`` names expressions
    to take from the previous row (null in a key's first row).  ``span`` and
    ``fan`` only affect speed.  ``nexts``: an empty list that takes ``next_chunks``
    of these rows, or has those of rows of the same keys, positions and span.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(float(x)))
    keys = list(keys)
    lagged = lagged or {}
    pos = c(position).cast("long")
    payload = [x for x in df.columns if x not in keys]
    first = list(order) or []
    row = F.struct(*([F.col(o) for o in first] or [pos.alias("_p")]), *[x for x in payload if x not in first],
                   c(step).cast("double").alias("_a"), c(lo).cast("double").alias("_lo"),
                   c(hi).cast("double").alias("_hi"), *[e.alias(n) for n, e in lagged.items()])
    blocks = chunked_rows(df, keys, pos, row, span)
    opening = opening_chunks(df, shared_nexts(nexts, df, keys, pos, row, span), keys, pos, row, span)
    thin = F.transform("_rows", lambda r: F.struct(r["_a"].alias("a"), r["_lo"].alias("lo"), r["_hi"].alias("hi")))
    lags = lambda r: F.struct(F.lit(1).alias("_"), *[r[n].alias(n) for n in lagged])
    chunks = with_ends(opening.select(*keys, "_c", "_nc", "_nl", _compose_chunk(thin).alias("_f"),
                                      lags(F.element_at("_rows", -1)).alias("_last")), keys)
    opened = clamp_openings(chunks, keys, chunks.schema["_last"].dataType, init, fan)
    j = blocks.join(opened.hint("shuffle_hash"), [*keys, "_c"], "left").withColumn(
        "s_in", F.coalesce("s_in", F.lit(float(init))))
    zipped = [F.col("_rows").alias("r"), _fold_chunk(F.col("s_in"), F.col("s_prev"), thin).alias("s")]
    if lagged:
        zipped.append(shifted(F.col("_before"), F.transform("_rows", lags)).alias("b"))
    z = j.select(*keys, F.inline(F.arrays_zip(*zipped)))
    cols = [F.col(f"r.{x}").alias(x) for x in payload]
    cols += [F.col(f"s.{f}").alias(n) for f, n in (("s", out), ("s0", prev_out), ("sp", prev2_out)) if n]
    return z.select(*keys, *cols, *[F.col(f"b.{n}").alias(n) for n in lagged])
