"""Serve-first dispatch (D2, D3) of many candidates over the same intervals.

A candidate is a *lane*.  The intervals lie in a stored table of time chunks
(``stored_chunks``), one array each, dealt out by (site, chunk) once and read from
there by everything else.  The lanes of a site lie in blocks of at most about
``BLOCK_BYTES`` of balances, and a block meets the chunks of its site by equality
(site, chunk), or (site, chunk, block) where a site may have several.  No task
holds more than some blocks at once, however many candidates a site has.

Kernels work on all lanes of an Arrow batch as the columns of one matrix: an
interval is one vector operation.  ``lane_metrics`` also computes the flows there
and hands on the sums of a lane's chunk, so no row of the fan-out exists outside
a kernel; ``lane_dispatch`` returns the rows themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.config import (battery2_energy_mwh, battery_energy_mwh, gas_co2_tons_per_mwh, gas_no_load_cost,
                             gas_variable_cost)
from wattline.functions.profiles import synthetic_load
from wattline.operators.balance import _CLAMPS, SPAN, bucketed, chunked_rows, openings, shifted, shuffle_partitions, stored
from wattline.operators.dispatch import EPS_ON, KEYS, _attach, _derive, _flows, finish, marginal_gas_cost, seconds_of

#: Bytes of the balances of one block over one chunk; the block's lanes follow from it.
BLOCK_BYTES = 2 << 20
#: Columns of a matrix that are scanned at once.
COLUMNS = 512
#: Chunks of a group whose openings are found together: they hold the clamps of all lanes of a block.
FAN = 256

_INPUTS = ("wind_mw", "solar_mw", "natgas_mw", "load_mw", "price")
#: A lane's numbers: profile factors and load level (null: as it is), battery, must-run gas, gas limits and costs.
_LANE = ("sk", "wk", "load", "p", "e", "eta", "dt", "must", "pmax", "pmin", "use_cap", "gas_ok", "marginal", "poi", "var",
         "startup", "noload")
#: How a lane's must-run gas follows from the gas column.
NO_GAS, PROFILE, FLAT, CAPPED = 0.0, 1.0, 2.0, 3.0
#: Sums of a lane over a chunk, in the names of ``operators.metrics``.
_ADDED = ("_n", "_load", "_served", "_unserved", "_merchant", "_gas_cost", "_wind", "_solar", "_natgas", "_charge", "_clip",
          "_gen", "_imp", "_exp", "_dis1", "_clip_rev", "_starts", "_on", "_serve_p", "_avail_p")
_LEAST = ("_soc1_min", "_clip_min")
_MOST = ("_cap_max", "_soc1_max", "_imp_max", "_exp_max", "_infeasible")
_D = T.DoubleType()
_SUMS = T.StructType([T.StructField(n, _D) for n in (*_ADDED, *_LEAST, *_MOST)])
_STATES = T.ArrayType(_D)


# ---------------------------------------------------------------------------
# stored chunks
# ---------------------------------------------------------------------------

def chunk_position(dt_hours: float = 1.0) -> Column:
    return F.floor(seconds_of(F.col("ts")) / F.lit(3600.0 * dt_hours)).cast("long")


def stored_chunks(iv: DataFrame, dt_hours: float = 1.0) -> DataFrame:
    """site_id, _c, _rows (a chunk's intervals in order) and facts of the chunk,
    stored once in the shared folder, bucketed by (site, chunk): joins on these
    read it without an exchange, and facts are read without the rows."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    value = {c: zero(c) for c in _INPUTS[:4]} | {"natgas_mw": F.greatest(F.lit(0.0), zero("natgas_mw"))}
    row = F.struct("ts", *[value[c].alias(c) for c in _INPUTS[:4]], "price")
    return _stored(chunked_rows(iv, ["site_id"], chunk_position(dt_hours), row))


def _stored(chunks: DataFrame) -> DataFrame:
    top = lambda c: F.array_max(F.transform("_rows", lambda r: r[c]))
    add = lambda f: F.aggregate("_rows", F.lit(0.0), lambda a, r: a + f(r))
    return bucketed(chunks.select(
        "site_id", "_c", "_rows", F.element_at("_rows", -1).alias("_last"), top("solar_mw").alias("solar_top"),
        top("wind_mw").alias("wind_top"), add(lambda r: r["natgas_mw"]).alias("gas_sum"),
        add(lambda r: F.abs(r["load_mw"])).alias("load_sum"),
        F.element_at("_rows", 1)["ts"].alias("first_ts"), F.element_at("_rows", -1)["ts"].alias("last_ts")),
        ["site_id", "_c"], "chunks")


def windowed_chunks(chunks: DataFrame, site_config: DataFrame) -> DataFrame:
    """The chunks cut to each site's own window (P1), with the site's synthetic
    load where its load is absent or zero throughout the window (P11).

    ``site_config`` has site_id and ``run_config`` (start_date, end_date: whole
    days; load_type, base_load_mw, load_std).  A chunk is met by an interval
    join on its first and last time, so chunks outside the window are dropped
    by their facts, before their rows are read into anything.  The rows are only
    joined by (site, chunk), as they lie.
    """
    c = F.col
    days = site_config.select(
        "site_id", c("run_config.start_date").cast("timestamp_ntz").alias("_lo"),
        F.date_add(c("run_config.end_date").cast("date"), 1).cast("timestamp_ntz").alias("_hi"),
        c("run_config.load_type").alias("_type"), c("run_config.base_load_mw").alias("_mw"),
        c("run_config.load_std").alias("_std"))
    inside = chunks.select("site_id", "_c", "first_ts", "last_ts").join(days.hint("shuffle_hash"), "site_id").where(
        (c("last_ts") >= c("_lo")) & (c("first_ts") < c("_hi")))
    whole = (c("first_ts") >= c("_lo")) & (c("last_ts") < c("_hi"))
    cut = F.filter("_rows", lambda r: (r["ts"] >= c("_lo")) & (r["ts"] < c("_hi")))
    met = lambda by: chunks.select("site_id", "_c", "_rows").join(by.hint("shuffle_hash"), ["site_id", "_c"]).withColumn(
        "_rows", F.when(whole, c("_rows")).otherwise(cut)).where(F.size("_rows") > 0)
    load = F.aggregate("_rows", F.lit(0.0), lambda a, r: a + F.abs(r["load_mw"]))
    idle = met(inside).groupBy("site_id").agg((F.sum(load) < F.lit(1e-9)).alias("_idle"))
    made = F.transform("_rows", lambda r: r.withField("load_mw", synthetic_load(
        r["ts"], c("site_id"), c("_type"), c("_mw"), c("_std"))))
    return _stored(met(inside.join(idle.hint("shuffle_hash"), "site_id")).select(
        "site_id", "_c", F.when(c("_idle"), made).otherwise(c("_rows")).alias("_rows")))


def site_facts(chunks: DataFrame) -> DataFrame:
    """One row per site from the facts of its chunks: reference MW (A24), whether
    the gas and load columns are zero throughout, the last chunk."""
    ref = lambda c: F.coalesce(F.ceil(F.max(F.greatest(F.col(c), F.lit(0.0)))).cast("double"), F.lit(0.0))
    return chunks.groupBy("site_id").agg(
        ref("solar_top").alias("ref_solar_mw"), ref("wind_top").alias("ref_wind_mw"),
        (F.sum("gas_sum") <= F.lit(1e-9)).alias("_ng_zero"), (F.sum("load_sum") < F.lit(1e-9)).alias("_load_zero"),
        F.max("_c").alias("_last_c"))


# ---------------------------------------------------------------------------
# kernels
# ---------------------------------------------------------------------------

@dataclass
class Piece:
    """One chunk of a site with one block of its lanes: interval columns of n
    numbers, lane columns of m numbers, and the matrix columns they take."""

    rows: dict[str, np.ndarray]
    lanes: dict[str, np.ndarray]
    first: int

    @property
    def n(self) -> int:
        return len(self.rows["load_mw"])

    @property
    def m(self) -> int:
        return len(self.lanes["p"])

    @property
    def columns(self) -> slice:
        return slice(self.first, self.first + self.m)


def _fields(arr: pa.Array, names: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets of a list of structs, and its fields as flat numbers (null: NaN)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return arr.offsets.to_numpy(), {n: arr.values.field(n).to_numpy(zero_copy_only=False).astype(float) for n in names}


def _pieces(rows: pa.Array, lanes: pa.Array) -> list[Piece]:
    r_at, r = _fields(rows, _INPUTS)
    l_at, l = _fields(lanes, _LANE)
    out, first = [], 0
    for k in range(len(rows)):
        at, of = slice(r_at[k], r_at[k + 1]), slice(l_at[k], l_at[k + 1])
        out.append(Piece({c: v[at] for c, v in r.items()}, {c: v[of] for c, v in l.items()}, first))
        first += out[-1].m
    return out


def _profiles(rows: Mapping[str, np.ndarray], lane: Mapping[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Wind, solar, must-run gas and load of each interval (row) and lane (column).
    What is the same in all rows or lanes comes as one of them."""
    scaled = lambda x, k: x[:, None] * np.where(np.isnan(k), 1.0, k)
    ng, kind = rows["natgas_mw"][:, None], lane["must"]
    if (kind == NO_GAS).all():
        must = np.zeros((1, len(kind)))
    elif (kind <= PROFILE).all() and np.isfinite(ng).all():
        must = ng * kind
    else:
        must = np.select([kind == NO_GAS, kind == PROFILE, kind == FLAT], [np.zeros_like(ng), ng, lane["pmax"]],
                         np.minimum(ng, lane["pmax"]))
    level = np.isnan(lane["load"])
    load = rows["load_mw"][:, None] if level.all() else np.where(level, rows["load_mw"][:, None], lane["load"])
    return scaled(rows["wind_mw"], lane["wk"]), scaled(rows["solar_mw"], lane["sk"]), must, load


def _steps(piece: Piece) -> np.ndarray:
    """The battery's step of each interval and lane, as the dispatch's expressions have it."""
    wind, solar, must, load = _profiles(piece.rows, piece.lanes)
    lane = piece.lanes
    x = ((wind + solar) + must) - load
    return np.where(x >= 0, (lane["eta"] * lane["dt"]) * np.minimum(lane["p"], x), (-lane["dt"]) * np.minimum(lane["p"], -x))


def _slabs(pieces: list[Piece]):
    """Runs of pieces of at most COLUMNS columns, with their steps as one matrix
    (zero steps after a piece's end) and the batteries' sizes."""
    lo = 0
    while lo < len(pieces):
        hi, width = lo, 0
        while hi < len(pieces) and (hi == lo or width + pieces[hi].m <= COLUMNS):
            width += pieces[hi].m
            hi += 1
        part = pieces[lo:hi]
        base = part[0].first
        a = np.zeros((max(p.n for p in part), width))
        for p in part:
            a[:p.n, p.first - base:p.first - base + p.m] = _steps(p)
        size = np.concatenate([p.lanes["e"] for p in part])
        yield part, base, a, size
        lo = hi


def _balances(pieces: list[Piece], opened: np.ndarray):
    """For each piece its balances after each interval (row) and lane (column)."""
    for part, base, a, size in _slabs(pieces):
        s = opened[base:base + a.shape[1]]
        for t in range(len(a)):
            s = np.minimum(np.maximum(s + a[t], 0.0), size)
            a[t] = s
        for p in part:
            yield p, a[:p.n, p.first - base:p.first - base + p.m]


@F.arrow_udf(T.ArrayType(_CLAMPS))
def _compose(rows: pa.Array, lanes: pa.Array) -> pa.Array:
    pieces = _pieces(rows, lanes)
    total = sum(p.m for p in pieces)
    out = np.zeros((6, total))
    for part, base, a, size in _slabs(pieces):
        width = a.shape[1]
        add, lo, hi = np.zeros(width), np.full(width, -np.inf), np.full(width, np.inf)
        last = np.concatenate([np.full(p.m, p.n - 1) for p in part])
        stops = set(last.tolist())
        for t in range(len(a)):
            if t in stops:  # a clamp without the chunk's last step
                at = np.flatnonzero(last == t)
                out[3:, base + at] = add[at], lo[at], hi[at]
            add = add + a[t]
            lo = np.minimum(np.maximum(lo + a[t], 0.0), size)
            hi = np.minimum(np.maximum(hi + a[t], 0.0), size)
        out[:3, base:base + width] = add, lo, hi
    vals = pa.StructArray.from_arrays([pa.array(c) for c in out], names=_CLAMPS.names)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[p.m for p in pieces]]), pa.int32()), vals)


def _numbers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a list of numbers, and the numbers (null: NaN)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return arr.offsets.to_numpy(), arr.values.to_numpy(zero_copy_only=False).astype(float)


def _functions(arr: pa.Array):
    """For each list of chunks their clamps: a row for each number, a column for
    each lane (None: the chunk opens no other)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offs, known, at = arr.offsets.to_numpy(), np.asarray(arr.values.is_valid()), arr.values.offsets.to_numpy()
    flat = np.stack([arr.values.values.field(n).to_numpy(zero_copy_only=False).astype(float) for n in _CLAMPS.names])
    for lo, hi in zip(offs[:-1], offs[1:]):
        yield [flat[:, at[k]:at[k + 1]] if known[k] else None for k in range(lo, hi)]


def _clamped(s: np.ndarray, f: np.ndarray) -> np.ndarray:
    return np.minimum(f[2], np.maximum(f[1], s + f[0]))


@F.arrow_udf(T.ArrayType(_CLAMPS))
def _compose_lanes(clamps: pa.Array) -> pa.Array:
    """The clamps of each lane over the chunks of a group, as one (null: no chunk has any)."""
    out = []
    for chunks in _functions(clamps):
        whole = None
        for f in chunks:
            if f is None:
                continue
            if whole is None:
                whole = f
            else:
                whole = np.stack([x for g in (f[:3], f[3:]) for x in (
                    whole[0] + g[0], _clamped(whole[1], g), _clamped(whole[2], g))])
        out.append(whole)
    offs = np.cumsum([0, *[0 if f is None else f.shape[1] for f in out]])
    some = [f for f in out if f is not None]
    flat = np.concatenate(some, axis=1) if some else np.zeros((6, 0))
    vals = pa.StructArray.from_arrays([pa.array(x) for x in flat], names=_CLAMPS.names)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), vals, mask=pa.array([f is None for f in out], pa.bool_()))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("s_in", _STATES), T.StructField("s_prev", _STATES)])))
def _fold_lanes(s_in: pa.Array, s_prev: pa.Array, clamps: pa.Array) -> pa.Array:
    """The balances of the lanes before each chunk, and before the row before it (null: where they start)."""
    lists = lambda x: x.to_numpy(zero_copy_only=False)
    out = []
    for s, sp, chunks in zip(lists(s_in), lists(s_prev), _functions(clamps)):
        rows = []
        for f in chunks:
            rows.append({"s_in": s, "s_prev": sp})
            if f is not None:
                was = np.zeros(f.shape[1]) if s is None else s
                s, sp = _clamped(was, f[:3]), _clamped(was, f[3:])
        out.append(rows)
    state = pa.list_(pa.float64())
    return pa.array(out, pa.list_(pa.struct([("s_in", state), ("s_prev", state)])))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _fold(rows: pa.Array, lanes: pa.Array, s_in: pa.Array) -> pa.Array:
    pieces = _pieces(rows, lanes)
    done = [s.T.ravel() for _, s in _balances(pieces, _numbers(s_in)[1])]
    sizes = np.concatenate([[0], *[np.full(p.m, p.n) for p in pieces]])
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(done) if done else np.zeros(0)))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[p.m for p in pieces]]), pa.int32()), inner)


def _gas(rows: Mapping[str, np.ndarray], lane: Mapping[str, np.ndarray], load: np.ndarray, gen: np.ndarray,
         charge: np.ndarray, discharge: np.ndarray, grid_on: bool) -> tuple[np.ndarray, np.ndarray]:
    """Output of dispatchable gas, and the gas cap."""
    pmax, use = lane["pmax"], lane["use_cap"] > 0
    cap = pmax[None, :]
    if use.any():
        ng = rows["natgas_mw"][:, None]
        cap = np.where(use, np.where(pmax > 0, np.minimum(ng, pmax), ng), pmax)
    high = np.maximum(0.0, np.minimum(np.where(pmax > 0, pmax, cap), cap))
    low = np.minimum(np.maximum(0.0, lane["pmin"]), high)
    ok = lane["gas_ok"] > 0
    if grid_on:
        ok = ok & (lane["marginal"] < rows["price"][:, None])
    need = np.maximum(0.0, load + charge - gen - discharge)
    return np.where(ok & (need > 1e-9), np.maximum(low, np.minimum(high, need)), 0.0), cap


def _flow(rows: Mapping[str, np.ndarray], lane: Mapping[str, np.ndarray], s: np.ndarray, before: np.ndarray, grid_on: bool):
    wind, solar, must, load = _profiles(rows, lane)
    gen = (wind + solar) + must
    step = s - before
    up = np.maximum(step, 0.0)
    charge, discharge = up / (lane["eta"] * lane["dt"]), (up - step) / lane["dt"]
    gas, cap = _gas(rows, lane, load, gen, charge, discharge, grid_on)
    return wind, solar, must, load, gen, charge, discharge, gas, cap


def lane_sums(piece: Piece, s: np.ndarray, s_in: np.ndarray, s_prev: np.ndarray, last: Mapping[str, np.ndarray] | None,
              grid_on: bool) -> np.ndarray:
    """The sums ``_SUMS`` of each lane of a piece: a row for each sum.

    ``last`` has the interval before the chunk (None: there is none), ``s_prev``
    and ``s_in`` the balances before and after it.  What is the same in all
    intervals of a lane is multiplied with its sums.
    """
    rows, lane, dt, n, m = piece.rows, piece.lanes, piece.lanes["dt"], piece.n, piece.m
    prev = np.vstack([s_in[None, :], s[:-1]])
    wind, solar, must, load, gen, charge, discharge, gas_d, cap = _flow(rows, lane, s, prev, grid_on)
    price = np.nan_to_num(rows["price"], nan=0.0)  # a missing price adds nothing to a sum of money
    supply = gen + gas_d + discharge - charge
    none = np.zeros(m)
    total = lambda x: np.broadcast_to(x, (n, m)).sum(0)
    worth = lambda x: (price[:, None] * x).sum(0)
    if grid_on:
        imp, surplus = np.maximum(0.0, load - supply), np.maximum(0.0, supply - load)
        exp = np.minimum(lane["poi"], surplus)
        clipped, served, unserved = surplus - exp, total(load), none
        merchant, imported, exported = worth(exp - imp), imp.sum(0), exp.sum(0)
        imp_max, exp_max = imp.max(0), np.abs(exp).max(0)
        bad = imp_max > lane["poi"] + 1e-9
    else:
        serve = np.minimum(load, supply)
        clipped, served, unserved = np.maximum(0.0, supply - serve), serve.sum(0), (load - serve).sum(0)
        merchant = imported = exported = imp_max = exp_max = bad = none
    gas = must + gas_d
    on = gas > EPS_ON
    was = np.zeros(m, bool)
    if last is not None:
        _, _, must0, _, _, _, _, g, _ = _flow(last, lane, s_in[None, :], s_prev[None, :], grid_on)
        was = (must0 + g > EPS_ON)[0] & ~np.isnan(s_prev)
    start = on.copy()
    start[1:] &= ~on[:-1]
    start[0] &= ~was
    starts, ran, natgas = start.sum(0), on.sum(0), gas.sum(0)
    available = total(np.maximum(wind, 0.0) + np.maximum(solar, 0.0) + np.maximum(gas, 0.0))
    return np.stack([np.full(m, float(n)), total(load) * dt, served * dt, unserved * dt, merchant * dt,
                     natgas * lane["var"] * dt + starts * lane["startup"] + ran * lane["noload"] * dt, wind.sum(0) * dt,
                     solar.sum(0) * dt, natgas * dt, charge.sum(0) * dt, clipped.sum(0) * dt, (gen + gas_d).sum(0) * dt,
                     imported * dt, exported * dt, discharge.sum(0) * dt, worth(clipped) * dt, starts, ran, served, available,
                     s.min(0), clipped.min(0), np.broadcast_to(cap, (n, m)).max(0), s.max(0), imp_max, exp_max, bad])


def _summing(grid_on: bool) -> Callable:
    @F.arrow_udf(T.ArrayType(_SUMS))
    def sums(rows: pa.Array, lanes: pa.Array, s_in: pa.Array, s_prev: pa.Array, before: pa.Array) -> pa.Array:
        pieces = _pieces(rows, lanes)
        opened, earlier = _numbers(s_in)[1], _numbers(s_prev)[1]
        if isinstance(before, pa.ChunkedArray):
            before = before.combine_chunks()
        known = np.asarray(before.is_valid())
        last = {c: before.field(c).to_numpy(zero_copy_only=False).astype(float) for c in _INPUTS}
        done = []
        for k, (p, s) in enumerate(_balances(pieces, opened)):
            had = {c: v[k:k + 1] for c, v in last.items()} if known[k] and p.m else None
            done.append(lane_sums(p, s, opened[p.columns], earlier[p.columns], had, grid_on)
                        if p.m else np.zeros((len(_SUMS), 0)))
        flat = np.concatenate(done, axis=1) if done else np.zeros((len(_SUMS), 0))
        vals = pa.StructArray.from_arrays([pa.array(x) for x in flat], names=_SUMS.names)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[p.m for p in pieces]]), pa.int32()), vals)

    return sums


# ---------------------------------------------------------------------------
# lanes meet chunks
# ---------------------------------------------------------------------------

def _lane_inputs() -> list[Column]:
    """The kernel's inputs of a lane, from its configuration columns."""
    c = F.col
    pmax = F.when(c("gas_pmax_mw") > 0, c("gas_pmax_mw")).otherwise(F.lit(0.0))
    must = (F.when(c("gas_enabled") & c("gas_dispatchable"), F.lit(NO_GAS))
            .when(c("gas_enabled"), F.when((pmax > 0) & c("_ng_zero"), F.lit(FLAT)).when(pmax > 0, F.lit(CAPPED))
                  .otherwise(F.lit(PROFILE))).otherwise(F.lit(PROFILE)))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    ok = c("gas_enabled") & c("gas_dispatchable") & (marginal_gas_cost() < c("voll_usd_per_mwh"))
    values = [c("_sk"), c("_wk"), c("_load"), c("battery_power_mw"), battery_energy_mwh(), c("rte"), c("dt_hours"), must, pmax,
              c("gas_pmin_mw"), flag(c("gas_use_profile_as_cap")), flag(ok), marginal_gas_cost(), c("poi_limit_mw"),
              gas_variable_cost(), c("gas_startup_cost_usd"), gas_no_load_cost()]
    return [v.cast("double").alias(n) for v, n in zip(values, _LANE)]


@dataclass
class Lanes:
    """Blocks of lanes with the chunks they meet (``base``), and how they open (``opened``)."""

    base: DataFrame
    opened: DataFrame
    keys: list[str]
    own: list[str]
    deal: list[str]

    def joined(self) -> DataFrame:
        start = lambda x, none: F.coalesce(x, F.transform("_lanes", lambda _: none))
        return self.base.join(self.opened.hint("shuffle_hash"), self.deal).withColumns({
            "s_in": start("s_in", F.lit(0.0)), "s_prev": start("s_prev", F.lit(None).cast("double"))})


def _thin(rows: str = "_rows") -> Column:
    return F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in _INPUTS]))


def _slim(lanes: str = "_lanes") -> Column:
    return F.transform(lanes, lambda r: F.struct(*[r[c].alias(c) for c in _LANE]))


def lanes_of(chunks: DataFrame, lanes: DataFrame, keys: Sequence[str], cfg: Mapping[str, Any] | None,
             most_lanes: int | None = None, block_bytes: int = BLOCK_BYTES) -> Lanes:
    """Deal the lanes into blocks, and find the balances with which chunks open.

    ``most_lanes`` is a bound on the lanes of a site where the caller has one: if
    they fit a block, blocks need no deal of their own.  The last chunk of a
    site opens nothing, so it is not composed.
    """
    lane_keys = [k for k in keys if k != "site_id"]
    own = [c for c in lanes.columns if c not in (*keys, "_sk", "_wk", "_load")]
    per_block = max(block_bytes // (8 * SPAN), 1)
    spread = most_lanes is None or most_lanes > per_block
    deal = ["site_id", "_c", *(["_lb"] if spread else [])]
    d = _attach(lanes, cfg)
    if spread:
        count = lanes.groupBy("site_id").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("_nb"))
        d = d.join(count.hint("shuffle_hash"), "site_id").withColumn("_lb", F.pmod(F.hash(*lane_keys), F.col("_nb")).cast("int"))
    else:
        d = d.withColumn("_lb", F.lit(0))
    blocks = d.groupBy("site_id", "_lb").agg(F.array_sort(F.collect_list(
        F.struct(*lane_keys, *_lane_inputs(), *[F.col(c).alias(f"c_{c}") for c in own]))).alias("_lanes"))
    # read in several places below: as a table, so that the plan doesn't repeat how the lanes came about at each
    blocks = stored(blocks, "lanes")
    # a table of lanes is small as a file and large in memory: by the file's size Spark would send it to the driver
    ids = chunks.select("site_id", "_c").withColumn("_last_c", F.max("_c").over(Window.partitionBy("site_id")))
    pairs = blocks.join(ids.hint("shuffle_hash"), "site_id")
    base = chunks.select("site_id", "_c", "_rows", "_last").join(pairs.hint("shuffle_hash"), ["site_id", "_c"])
    if spread:  # the blocks of a chunk go to different tasks
        base = base.repartition(shuffle_partitions(chunks), *deal)
    opening = base.where("_c < _last_c").select("site_id", "_lb", "_c", _compose(_thin(), _slim()).alias("_f"), "_last")
    none = {n: F.lit(None).cast(opening.schema[n].dataType).alias(n) for n in ("_f", "_last")}
    functions = opening.unionByName(pairs.where("_c = _last_c").select("site_id", "_lb", "_c", *none.values()))
    start = F.lit(None).cast(_STATES)
    opened = openings(functions, ["site_id", "_lb"], compose=_compose_lanes, fold=_fold_lanes, init=start, init_prev=start,
                      last_type=functions.schema["_last"].dataType, fan=FAN).select(*deal, "s_in", "s_prev", "_before")
    # a table too: how chunks open is the larger part of a sweep's plan, and the driver plans it anew after each stage
    return Lanes(base, stored(opened, "openings"), lane_keys, own, deal)


def lane_metrics(chunks: DataFrame, lanes: DataFrame, keys: Sequence[str] = KEYS, cfg: Mapping[str, Any] | None = None,
                 grid_on: bool = False, most_lanes: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The sums over the dispatch of every lane, one row per key: what
    ``operators.metrics.metrics_of`` takes.

    ``lanes`` has a row for each of ``keys``: _sk and _wk (factors of the solar
    and wind profile, null: as it is), _load (a level instead of the load,
    null: as it is), _ng_zero (the site's gas column is zero throughout), and
    configuration columns; those it lacks come from ``cfg``.
    """
    ls = lanes_of(chunks, lanes, keys, cfg, most_lanes, block_bytes)
    c = F.col
    before = F.when(c("_before").isNotNull(), F.struct(*[c(f"_before.{x}").alias(x) for x in _INPUTS]))
    z = ls.joined().select("site_id", F.inline(F.arrays_zip(
        c("_lanes").alias("l"), _summing(grid_on)(_thin(), _slim(), c("s_in"), c("s_prev"), before).alias("s"))))
    z = _attach(z.select("site_id", *[c(f"l.{k}").alias(k) for k in ls.keys], *[c(f"l.c_{x}").alias(x) for x in ls.own],
                         "s.*"), cfg)
    facts = {"dt_hours": c("dt_hours"), "_e1": battery_energy_mwh(), "_e2": battery2_energy_mwh(), "_pmax": c("gas_pmax_mw"),
             "_var": gas_variable_cost(), "_noload": gas_no_load_cost(), "_startup": c("gas_startup_cost_usd"),
             "_voll": c("voll_usd_per_mwh"), "_deg": c("bess_deg_cost_usd_per_mwh"), "_carbon": c("carbon_price_usd_per_ton"),
             "_co2r": gas_co2_tons_per_mwh()}
    zero = F.lit(0.0)
    return z.groupBy(*keys).agg(
        *[F.first(v).alias(n) for n, v in facts.items()], *[F.sum(n).alias(n) for n in _ADDED],
        *[F.min(n).alias(n) for n in _LEAST], *[F.max(n).alias(n) for n in _MOST]).withColumns(
            {"_dis2": zero, "_soc2_min": zero, "_soc2_max": zero})


def lane_dispatch(chunks: DataFrame, lanes: DataFrame, keys: Sequence[str] = KEYS, cfg: Mapping[str, Any] | None = None,
                  grid_on: bool = False, most_lanes: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The dispatch rows of every lane of a site over the site's intervals
    (``lanes`` as in ``lane_metrics``)."""
    ls = lanes_of(chunks, lanes, keys, cfg, most_lanes, block_bytes)
    j = ls.joined()
    laid = j.select("site_id", "_rows", "_before", F.inline(F.arrays_zip(
        F.col("_lanes").alias("l"), F.col("s_in").alias("si"), F.col("s_prev").alias("sp"),
        _fold(_thin(), _slim(), F.col("s_in")).alias("s"))))
    n = F.size("_rows")
    before = F.slice(F.concat(F.array("si"), F.col("s")), 1, n)
    before2 = F.slice(F.concat(F.array("sp", "si"), F.col("s")), 1, n)
    z = laid.select("site_id", "l", F.inline(F.arrays_zip(
        F.col("_rows").alias("r"), F.col("s").alias("soc1"), before.alias("_s1p"), before2.alias("_s1pp"),
        shifted(F.col("_before"), F.col("_rows")).alias("b"))))
    scaled = lambda row, c, k: F.when(F.col(f"l.{k}").isNull(), F.col(f"{row}.{c}")).otherwise(
        F.col(f"{row}.{c}") * F.col(f"l.{k}"))
    level = lambda row: F.coalesce(F.col("l.load"), F.col(f"{row}.load_mw"))
    d = z.select(
        "site_id", *[F.col(f"l.{k}").alias(k) for k in ls.keys], F.col("r.ts").alias("ts"),
        scaled("r", "wind_mw", "wk").alias("wind_mw"), scaled("r", "solar_mw", "sk").alias("solar_mw"),
        F.col("r.natgas_mw").alias("natgas_mw"), level("r").alias("load_mw"), F.col("r.price").alias("price"),
        "soc1", "_s1p", "_s1pp",
        (scaled("b", "wind_mw", "wk") + scaled("b", "solar_mw", "sk")).alias("_p_gen_ren"),
        F.col("b.natgas_mw").alias("_p_natgas_mw"), F.when(F.col("b.ts").isNotNull(), level("b")).alias("_p_load_mw"),
        F.col("b.price").alias("_p_price"), *[F.col(f"l.c_{c}").alias(c) for c in ls.own])
    d = _derive(_attach(d, cfg), grid_on, False)
    c1, d1 = _flows("soc1", "_s1p", F.col("rte"), F.col("dt_hours"))
    return finish(d.withColumns({"charge1": c1, "discharge1": d1, "charge2": F.lit(0.0), "discharge2": F.lit(0.0),
                                 "soc2": F.lit(0.0)}), grid_on=grid_on)
