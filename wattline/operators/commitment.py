"""Gas commitment with minimum up and down times as a parallel scan.

A unit that runs must go on for ``up`` intervals, one that stopped must rest for
``down``; beyond that it follows what is wanted.  The state is one number: h > 0
on for h intervals (``up`` or longer counts as ``up``), -h off for h (``down`` or
longer counts as ``down``).  An interval maps each state to the next::

    on,  h < up or wanted       -> on, h + 1      on, else  -> off, 1
    off, h >= down and wanted   -> on, 1          off, else -> off, h + 1

Such maps over ``up + down`` states compose into one another, so a chunk of
intervals is one small table, and the states with which chunks open come from a
scan over these tables, as the balance's do (``operators.balance``).  Before its
first interval a unit has been off for ever.

The kernels step through all chunks of an Arrow batch at once, one vector
operation for each interval.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.balance import FAN, SPAN, chunked_rows, opening_chunks, openings, shared_nexts, with_ends

#: Off for ever.
REST = -(1 << 30)

_MAP = T.StructType([T.StructField("down", T.IntegerType()), T.StructField("to", T.ArrayType(T.IntegerType()))])
_OPENINGS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("s_in", "s_prev")]))
_STATES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("s0", "s")]))


def min_periods(hours: str) -> Column:
    """Interval count of an hour-based minimum time: ceil(hours / dt), 0 when hours <= 0."""
    return F.when(F.col(hours) > 0, F.ceil(F.col(hours).cast("double") / F.col("dt_hours"))).otherwise(0) \
        .cast("long")


def advance(state: np.ndarray, want: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The next state of each element."""
    on = state > 0
    stay = np.where(on, want | (state < up), ~(want & (-state >= down)))
    held = np.where(on, np.minimum(state + 1, up), -np.minimum(1 - state, down))
    return np.where(stay, held, np.where(on, -1, 1))


def _lists(arr: pa.Array, fields: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and the fields of a list of structs, as flat arrays."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offs = arr.offsets.to_numpy()
    return offs, [arr.values.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _chunk_inputs(steps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, wanted (interval, chunk), and the minimum times of each chunk."""
    offs, (w, up, down) = _lists(steps, ("w", "up", "down"))
    n = np.diff(offs)
    want = np.zeros((int(n.max()) if len(n) else 0, len(n)), bool)
    for k, (lo, hi) in enumerate(zip(offs[:-1], offs[1:])):
        want[:hi - lo, k] = w[lo:hi]
    first = offs[:-1]
    return n, want, np.maximum(up[first], 1).astype(np.int64), np.maximum(down[first], 1).astype(np.int64)


@F.arrow_udf(_MAP)
def _compose_chunk(steps: pa.Array) -> pa.Array:
    n, want, up, down = _chunk_inputs(steps)
    size = up + down
    at = np.arange(int(size.max()) if len(size) else 0)[:, None]
    state = np.where(at < down, at - down, at - down + 1)  # -down..-1, 1..up
    state = np.minimum(state, up)
    for t in range(len(want)):
        state = np.where(t < n, advance(state, want[t], up, down), state)
    return _maps([(int(d), state[:k, j]) for j, (d, k) in enumerate(zip(down, size))])


def _maps(rows: list[tuple[int, np.ndarray]]) -> pa.Array:
    offs = np.cumsum([0, *[len(t) for _, t in rows]])
    flat = np.concatenate([t for _, t in rows]) if rows else np.zeros(0)
    return pa.StructArray.from_arrays(
        [pa.array([d for d, _ in rows], pa.int32()),
         pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.astype(np.int32)))], names=_MAP.names)


def apply(down: int, to: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States after the intervals of a map."""
    up = len(to) - down
    return to[np.where(state > 0, down + np.minimum(state, up) - 1, np.maximum(state, -down) + down)]


def _functions(arr: pa.Array):
    """For each list of maps, its maps as (down, table); None for that of a chunk
    that opens no other."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offs = arr.offsets.to_numpy()
    down = arr.values.field("down").to_numpy(zero_copy_only=False)
    to = arr.values.field("to").fill_null([])
    at, flat = to.offsets.to_numpy(), to.values.to_numpy(zero_copy_only=False)
    for lo, hi in zip(offs[:-1], offs[1:]):
        yield [(int(down[k]), flat[at[k]:at[k + 1]]) if at[k] < at[k + 1] else None for k in range(lo, hi)]


@F.arrow_udf(_MAP)
def _compose_group(maps: pa.Array) -> pa.Array:
    out = []
    for fs in _functions(maps):
        known = [f for f in fs if f]
        d, to = known[0] if known else (0, np.zeros(0))
        for f in known[1:]:
            to = apply(*f, to)
        out.append((d, to))
    return _maps(out)


@F.arrow_udf(_OPENINGS)
def _fold_group(s_in: pa.Array, s_prev: pa.Array, maps: pa.Array) -> pa.Array:
    out = []
    for s, fs in zip(s_in.to_pylist(), _functions(maps)):
        rows = []
        for f in fs:
            rows.append({"s_in": s, "s_prev": None})
            if f:
                s = int(apply(*f, np.array([s]))[0])
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("s_in", pa.int32()), ("s_prev", pa.int32())])))


@F.arrow_udf(_STATES)
def _fold_chunk(s_in: pa.Array, steps: pa.Array) -> pa.Array:
    n, want, up, down = _chunk_inputs(steps)
    state = s_in.to_numpy(zero_copy_only=False).astype(np.int64)
    before, after = np.zeros(want.shape, np.int32), np.zeros(want.shape, np.int32)
    for t in range(len(want)):
        before[t] = state
        state = advance(state, want[t], up, down)
        after[t] = state
    inside = np.arange(len(want))[:, None] < n
    vals = pa.StructArray.from_arrays([pa.array(x.T[inside.T]) for x in (before, after)], names=["s0", "s"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), vals)


def commit(df: DataFrame, keys: Sequence[str], position: Column, order: Sequence[str], want: Column, up: Column,
           down: Column, out: str, prev_out: str, span: int = SPAN, fan: int = FAN,
           nexts: list[DataFrame] | None = None) -> DataFrame:
    """Append the unit's status (1.0 on, 0.0 off) in each interval, and before it.

    ``up`` and ``down`` are numbers of intervals, the same in all rows of a key
    (0 counts as 1).  Rows are counted, so missing intervals don't matter;
    ``span`` and ``fan`` only affect speed; ``nexts`` as in ``bounded_balance``.
    """
    keys = list(keys)
    payload = [x for x in df.columns if x not in keys]
    row = F.struct(*[F.col(o) for o in order], *[x for x in payload if x not in order],
                   F.coalesce(want, F.lit(False)).alias("_w"), up.cast("int").alias("_u"), down.cast("int").alias("_d"))
    pos = position.cast("long")
    blocks = chunked_rows(df, keys, pos, row, span)
    opening = opening_chunks(df, shared_nexts(nexts, df, keys, pos, row, span), keys, pos, row, span)
    thin = F.transform("_rows", lambda r: F.struct(r["_w"].alias("w"), r["_u"].alias("up"), r["_d"].alias("down")))
    chunks = with_ends(opening.select(*keys, "_c", "_nc", "_nl", _compose_chunk(thin).alias("_f"),
                                      F.struct(F.lit(1).alias("_")).alias("_last")), keys)
    opened = openings(chunks, keys, compose=_compose_group, fold=_fold_group, init=F.lit(REST),
                      init_prev=F.lit(None).cast("int"), last_type=chunks.schema["_last"].dataType, fan=fan)
    j = blocks.join(opened.select(*keys, "_c", "s_in").hint("shuffle_hash"), [*keys, "_c"], "left").withColumn(
        "s_in", F.coalesce("s_in", F.lit(REST)))
    z = j.select(*keys, F.inline(F.arrays_zip(F.col("_rows").alias("r"), _fold_chunk(F.col("s_in"), thin).alias("s"))))
    status = lambda c: F.when(F.col(c) > 0, 1.0).otherwise(0.0)
    return z.select(*keys, *[F.col(f"r.{x}").alias(x) for x in payload], status("s.s").alias(out),
                    status("s.s0").alias(prev_out))
