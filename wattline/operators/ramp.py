"""D5's ordered fold: a value that follows a target within ramp limits.

    g_t = min(g_{t-1} + up_t, max(g_{t-1} - down_t, target_t)),   g_0 = 0

Each step is a non-decreasing piecewise-linear function of the previous value
(up to the target, level, then down from it), and such functions compose into
one another, so a key is cut into time chunks like the balance: a chunk gives
the points of its function between 0 and the largest value, most often a
single level, since a chunk that ends alike from both ends forgets where it
began.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.balance import FAN, SPAN, chunked_rows, laid_out, lists_of, matrices, opening_chunks, \
    openings, shared_nexts, shifted, with_ends

_LIST = T.ArrayType(T.DoubleType())
_CURVES = T.StructType([T.StructField(n, _LIST) for n in ("fx", "fy", "gx", "gy")])
_OPENINGS = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("s_in", "s_prev")]))
_STATES = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("s0", "s")]))

Curve = tuple[list, list]  # places and values; linear between, of slope 0 or 1


def step(g: float, up: float, down: float, target: float) -> float:
    return min(g + up, max(g - down, target))


def value(c: Curve, x: float) -> float:
    """A curve at ``x``, level beyond its ends."""
    xs, ys = c
    i = bisect_right(xs, x) - 1
    if i < 0:
        return ys[0]
    if i + 1 == len(xs) or ys[i] == ys[i + 1]:
        return ys[i]
    return min(ys[i] + (x - xs[i]), ys[i + 1])


def tidy(xs: list, ys: list) -> Curve:
    """Without the points inside a level or a slope."""
    keep = [i for i in range(len(xs)) if i in (0, len(xs) - 1) or not (
        (ys[i] == ys[i - 1]) == (ys[i + 1] == ys[i]))]
    return [xs[i] for i in keep], [ys[i] for i in keep]


def through(c: Curve, levels: Sequence[tuple[float, float]], image) -> Curve:
    """The curve ``c`` followed by the function ``image``, which turns only at
    the given levels; each comes with its image, so that level stretches have
    exactly equal ends."""
    xs, ys = c
    points = {x: image(y) for x, y in zip(xs, ys)}
    for level, value_there in levels:
        for i in range(len(xs) - 1):
            if ys[i] < level < ys[i + 1]:
                points[xs[i] + (level - ys[i])] = value_there
    xs = sorted(points)
    return tidy(xs, [points[x] for x in xs])


def compose_chunk(target, up, down, bound: float) -> tuple[list, list, list, list]:
    """The chunk's curve on [0, bound], and that of all its steps but the last."""
    lo, hi = 0.0, bound
    for t, u, d in zip(target[:-1], up[:-1], down[:-1]):
        lo, hi = step(lo, u, d, t), step(hi, u, d, t)

    def after(c: Curve, t, u, d) -> Curve:
        return through(c, ((t - u, t), (t + d, t)), lambda y: step(y, u, d, t))

    if lo == hi:
        g: Curve = ([0.0], [lo])
    else:
        g = ([0.0, bound], [0.0, bound])
        for t, u, d in zip(target[:-1], up[:-1], down[:-1]):
            g = after(g, t, u, d)
    return (*after(g, target[-1], up[-1], down[-1]), *g)


def then(f: Curve, g: Curve) -> Curve:
    """The curve that applies ``f``, then ``g``."""
    return through(f, list(zip(*g)), lambda y: value(g, y))


def _curves(rows: list[tuple]) -> pa.Array:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.StructArray.from_arrays([pa.array(c, pa.list_(pa.float64())) for c in cols], names=_CURVES.names)


@F.arrow_udf(_CURVES)
def _compose_chunk(steps: pa.Array) -> pa.Array:
    return _curves([compose_chunk(t, u, d, max(b)) for t, u, d, b in lists_of(steps, ("t", "u", "d", "b"))])


@F.arrow_udf(_CURVES)
def _compose_group(curves: pa.Array) -> pa.Array:
    out = []
    for cols in lists_of(curves, _CURVES.names):
        f: Curve | None = None
        g: Curve | None = None
        for fx, fy, gx, gy in zip(*cols):
            if fx is None:  # a chunk that opens no other
                continue
            g = (gx, gy) if f is None else then(f, (gx, gy))
            f = (fx, fy) if f is None else then(f, (fx, fy))
        out.append((*f, *g) if f else (None,) * 4)
    return _curves(out)


@F.arrow_udf(_OPENINGS)
def _fold_group(s_in: pa.Array, s_prev: pa.Array, curves: pa.Array) -> pa.Array:
    out = []
    for s, sp, cols in zip(s_in.to_pylist(), s_prev.to_pylist(), lists_of(curves, _CURVES.names)):
        rows = []
        for fx, fy, gx, gy in zip(*cols):
            rows.append({"s_in": s, "s_prev": sp})
            if fx is not None:
                s, sp = value((fx, fy), s), value((gx, gy), s)
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("s_in", pa.float64()), ("s_prev", pa.float64())])))


@F.arrow_udf(_STATES)
def _fold_chunk(s_in: pa.Array, steps: pa.Array) -> pa.Array:
    n, (target, up, down) = matrices(steps, ("t", "u", "d"))
    values = np.empty((len(target) + 1, len(n)))
    values[0] = s_in.to_numpy(zero_copy_only=False)
    for t in range(len(target)):
        values[t + 1] = np.minimum(values[t] + up[t], np.maximum(values[t] - down[t], target[t]))
    return laid_out(n, {"s0": values[:-1], "s": values[1:]})


def ramp_follow(df: DataFrame, keys: Sequence[str], position: Column, order: Sequence[str], target: Column, up: Column,
                down: Column, bound: Column, out: str, prev_out: str, lagged: dict[str, Column] | None = None,
                span: int = SPAN, fan: int = FAN, nexts: list[DataFrame] | None = None) -> DataFrame:
    """Append the value that follows ``target``, and the one before it.

    ``bound`` is a value that no target of the key exceeds; ``lagged`` and ``nexts`` as
    in ``bounded_balance``.
    """
    keys, lagged = list(keys), lagged or {}
    payload = [x for x in df.columns if x not in keys]
    row = F.struct(*[F.col(o) for o in order], *[x for x in payload if x not in order],
                   target.cast("double").alias("_t"), up.cast("double").alias("_u"), down.cast("double").alias("_d"),
                   bound.cast("double").alias("_b"), *[e.alias(n) for n, e in lagged.items()])
    pos = position.cast("long")
    blocks = chunked_rows(df, keys, pos, row, span)
    opening = opening_chunks(df, shared_nexts(nexts, df, keys, pos, row, span), keys, pos, row, span)
    thin = F.transform("_rows", lambda r: F.struct(r["_t"].alias("t"), r["_u"].alias("u"), r["_d"].alias("d"),
                                                   r["_b"].alias("b")))
    lags = lambda r: F.struct(F.lit(1).alias("_"), *[r[n].alias(n) for n in lagged])
    chunks = with_ends(opening.select(*keys, "_c", "_nc", "_nl", _compose_chunk(thin).alias("_f"),
                                      lags(F.element_at("_rows", -1)).alias("_last")), keys)
    opened = openings(chunks, keys, compose=_compose_group, fold=_fold_group, init=F.lit(0.0),
                      init_prev=F.lit(None).cast("double"), last_type=chunks.schema["_last"].dataType, fan=fan)
    j = blocks.join(opened.hint("shuffle_hash"), [*keys, "_c"], "left").withColumn("s_in", F.coalesce("s_in", F.lit(0.0)))
    z = j.select(*keys, F.inline(F.arrays_zip(
        F.col("_rows").alias("r"), _fold_chunk(F.col("s_in"), thin).alias("s"),
        shifted(F.col("_before"), F.transform("_rows", lags)).alias("b"))))
    return z.select(*keys, *[F.col(f"r.{x}").alias(x) for x in payload], F.col("s.s").alias(out),
                    F.col("s.s0").alias(prev_out), *[F.col(f"b.{n}").alias(n) for n in lagged])
