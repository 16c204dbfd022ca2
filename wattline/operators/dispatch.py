"""Dispatch operators: interval table + parameter columns -> dispatch table.

Input rows carry the key columns (default ``site_id, candidate_id``), the
interval columns (``ts wind_mw solar_mw natgas_mw load_mw price``) and the
run-configuration columns (``wattline.config``).  Parameters are columns, so
one plan dispatches one configuration or a whole candidate sweep.

* D1 ``scheduled_dispatch``  - fixed charge / discharge schedule
* D2 ``serve_first_dispatch`` (grid off) - renewables -> load, surplus ->
  battery -> clipped; deficit <- battery <- gas <- unserved
* D3 same, grid on - load always met, surplus -> battery -> export <= POI,
  deficit <- battery <- (gas if cheaper than the market) <- import
* D4 second battery runs on what the first leaves (``two_battery=True``)
* D5 ``gas_follow`` - ramp-limited gas output (ordered fold), and ``commitment`` -
  minimum up and down times (W5) kept by the dispatch

Rule-based: feasible, not optimal.  All state (battery balances) comes from
``operators.balance.bounded_balance``, ``operators.ramp.ramp_follow`` and
``operators.commitment.commit``, which also hand out what depends on the previous
row.
"""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.config import CONFIG_FIELDS, battery2_energy_mwh, battery_energy_mwh, gas_co2_tons_per_mwh, \
    gas_no_load_cost, gas_variable_cost, with_config
from wattline.functions.text import action_code
from wattline.operators.balance import bounded_balance
from wattline.operators.commitment import commit, min_periods
from wattline.operators.ramp import ramp_follow

KEYS = ["site_id", "candidate_id"]
EPS_ON = 1e-6
INTERVAL_COLS = ["ts", "wind_mw", "solar_mw", "natgas_mw", "load_mw", "price"]
RESULT_COLS = ["generation", "load", "price_per_kwh", "charge1", "discharge1", "charge2", "discharge2",
               "charge", "discharge", "serve", "grid_imp", "grid_exp", "clipped", "gas_gen", "unserved",
               "gas_on", "gas_start", "gas_stop", "gas_cost", "soc1", "soc2", "soc", "net_to_grid"]


CONFIG_NAMES = [n for n, _, _ in CONFIG_FIELDS]


def col(n: str) -> Column:
    return F.col(n)


def _attach(df: DataFrame, cfg: Mapping[str, Any] | None) -> DataFrame:
    """Literal parameter columns for a single configuration (folded by Catalyst).

    Parameters already present as columns (e.g. per-candidate sizes of a
    sweep) are kept; only the missing ones are added as literals.
    """
    return with_config(df, cfg, skip_existing=True) if cfg is not None else df


def _detach(df: DataFrame, cfg: Mapping[str, Any] | None) -> DataFrame:
    """Drop the literal parameter columns before a shuffle so they never travel with the rows."""
    if cfg is None:
        return df
    lit_names = [n for n in CONFIG_NAMES if n not in (cfg.get("_varying") or ())]
    return df.drop(*[c for c in lit_names if c in df.columns])


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a timestamp_ntz (no time-zone step)."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def interval_position(ts: str = "ts", dt: str = "dt_hours") -> Column:
    """Interval index: seconds since epoch / (dt_hours * 3600)."""
    return F.floor(seconds_of(F.col(ts)) / (F.col(dt) * F.lit(3600.0))).cast("long")


# ---------------------------------------------------------------------------
# Series preparation
# ---------------------------------------------------------------------------

def scale_renewables(df: DataFrame, ref_solar: Column | float, ref_wind: Column | float,
                     solar_mw: str = "cand_solar_mw", wind_mw: str = "cand_wind_mw") -> DataFrame:
    """Scale the solar / wind profile to the candidate MW (0 when no reference)."""
    rs = ref_solar if isinstance(ref_solar, Column) else F.lit(float(ref_solar))
    rw = ref_wind if isinstance(ref_wind, Column) else F.lit(float(ref_wind))
    return df.withColumns({
        "solar_mw": F.when(rs > 0, col("solar_mw") * (col(solar_mw) / rs)).otherwise(F.lit(0.0)),
        "wind_mw": F.when(rw > 0, col("wind_mw") * (col(wind_mw) / rw)).otherwise(F.lit(0.0)),
    })


def gas_cap(natgas: Column | None = None) -> Column:
    """Per-interval gas availability cap (static, profile, or least(profile, pmax)).

    The profile is the gas column (or a separate availability column, P3,
    passed as ``natgas``).
    """
    ng = F.greatest(F.lit(0.0), F.coalesce(natgas if natgas is not None else col("natgas_mw"), F.lit(0.0)))
    pmax = F.when(col("gas_pmax_mw") > 0, col("gas_pmax_mw")).otherwise(F.lit(0.0))
    use = col("gas_use_profile_as_cap")
    return (F.when((pmax > 0) & ~use, pmax)
            .when(use, F.when(pmax > 0, F.least(ng, pmax)).otherwise(ng))
            .otherwise(pmax))


def must_run_gas(natgas_all_zero: Column, natgas: Column | None = None) -> Column:
    """Fixed gas output when gas is not dispatchable."""
    ng = F.greatest(F.lit(0.0), F.coalesce(natgas if natgas is not None else col("natgas_mw"), F.lit(0.0)))
    pmax = F.when(col("gas_pmax_mw") > 0, col("gas_pmax_mw")).otherwise(F.lit(0.0))
    return (F.when(col("gas_enabled") & col("gas_dispatchable"), F.lit(0.0))
            .when(col("gas_enabled"),
                  F.when((pmax > 0) & natgas_all_zero, pmax).when(pmax > 0, F.least(ng, pmax)).otherwise(ng))
            .otherwise(ng))


def gas_limits(natgas: Column | None = None) -> tuple[Column, Column, Column]:
    """P14 + P16: gas cap, largest and smallest output of an interval."""
    cap = gas_cap(natgas)
    pmax = F.when(col("gas_pmax_mw") > 0, col("gas_pmax_mw")).otherwise(F.lit(0.0))
    pmax_t = F.greatest(F.lit(0.0), F.least(F.when(pmax > 0, pmax).otherwise(cap), cap))
    return cap, pmax_t, F.least(F.greatest(F.lit(0.0), col("gas_pmin_mw")), pmax_t)


def gas_column_zero(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P15's per-key fact: is the gas column zero throughout (``_ng_zero``)."""
    return df.groupBy(*keys).agg((F.sum(F.greatest(F.lit(0.0), F.coalesce(col("natgas_mw"), F.lit(0.0))))
                                  <= F.lit(1e-9)).alias("_ng_zero"))


def _with_gas_zero(df: DataFrame, keys: Sequence[str], cfg: Mapping[str, Any] | None) -> DataFrame:
    """Add ``_ng_zero`` where it matters: for must-run gas of an enabled unit."""
    if "_ng_zero" in df.columns:
        return df
    if cfg is not None and not set(cfg.get("_varying") or ()) & {"gas_enabled", "gas_dispatchable"} and (
            not cfg.get("gas_enabled") or cfg.get("gas_dispatchable")):
        return df.withColumn("_ng_zero", F.lit(False))
    return df.join(gas_column_zero(df, keys), list(keys), "left")


def prepare(df: DataFrame, keys: Sequence[str] = KEYS, cfg: Mapping[str, Any] | None = None) -> DataFrame:
    """Add gen_ren, gas_cap, pmax_t, pmin_t (P16), must_run (P15), gen, gas_disp."""
    return _prepared(_attach(_with_gas_zero(_detach(df, cfg), keys, cfg), cfg))


def _prepared(d: DataFrame) -> DataFrame:
    cap, pmax_t, pmin_t = gas_limits()
    d = d.withColumns({
        "gen_ren": F.coalesce(col("wind_mw"), F.lit(0.0)) + F.coalesce(col("solar_mw"), F.lit(0.0)),
        "gas_cap": cap, "pmax_t": pmax_t, "pmin_t": pmin_t, "must_run": must_run_gas(col("_ng_zero")),
        "gas_disp": col("gas_enabled") & col("gas_dispatchable"),
    })
    return d.withColumn("gen", col("gen_ren") + col("must_run"))


#: Columns of ``_prepared`` and of the battery inputs: cheap projections, dropped before an exchange.
DERIVED = ["gen_ren", "gas_cap", "gas_disp", "pmax_t", "pmin_t", "must_run", "gen", "_gas_ok", "_x"]


def marginal_gas_cost() -> Column:
    return gas_variable_cost() + col("carbon_price_usd_per_ton") * gas_co2_tons_per_mwh()


def _derive(d: DataFrame, grid_on: bool, gas_charges_storage: bool) -> DataFrame:
    """``_prepared``, whether gas is worth running, and the battery's input ``_x``."""
    d = _prepared(d).withColumn("_gas_ok", col("gas_disp") & (marginal_gas_cost() < col("voll_usd_per_mwh")))
    x = col("gen") - col("load_mw")
    if gas_charges_storage and not grid_on:
        x = x + F.when(col("_gas_ok") & ((marginal_gas_cost() / col("rte") + col("bess_deg_cost_usd_per_mwh"))
                                         < col("voll_usd_per_mwh")), col("pmax_t")).otherwise(F.lit(0.0))
    return d.withColumn("_x", x)


#: Inputs of the previous row from which its gas status follows.
def _lag_inputs(two_battery: bool) -> dict[str, Column]:
    out = {"_p_gen_ren": F.coalesce(col("wind_mw"), F.lit(0.0)) + F.coalesce(col("solar_mw"), F.lit(0.0)),
           "_p_natgas_mw": col("natgas_mw"), "_p_load_mw": col("load_mw"), "_p_price": col("price")}
    return out | ({"_p_charge1": col("charge1"), "_p_discharge1": col("discharge1")} if two_battery else {})


def _previous_gas_on(grid_on: bool, two_battery: bool) -> Column:
    """Gas on/off of the previous row from its inputs (``_p_*``) and its
    balances, by the expressions of the current row; null on a key's first row."""
    ng = col("_p_natgas_mw")
    _, pmax_t, pmin_t = gas_limits(ng)
    must = must_run_gas(col("_ng_zero"), ng)
    gen = col("_p_gen_ren") + must
    charge, discharge = ((col("_p_charge1"), col("_p_discharge1")) if two_battery
                         else _flows("_s1p", "_s1pp", col("rte"), col("dt_hours")))
    c2, d2 = (_flows("_s2p", "_s2pp", col("battery2_rte"), col("dt_hours")) if two_battery
              else (F.lit(0.0), F.lit(0.0)))
    need = F.greatest(F.lit(0.0), col("_p_load_mw") + (charge + c2) - gen - (discharge + d2))
    ok = col("_gas_ok") & (marginal_gas_cost() < col("_p_price")) if grid_on else col("_gas_ok")
    need = F.when(ok, need).otherwise(F.lit(0.0))
    on = F.when(must + _gas_output(need, pmin_t, pmax_t) > EPS_ON, 1.0).otherwise(0.0)
    return F.when(col("_p_load_mw").isNull(), F.lit(None).cast("double")).otherwise(on)


def _gas_output(need: Column, pmin_t: Column, pmax_t: Column) -> Column:
    return F.when(need > 1e-9, F.greatest(pmin_t, F.least(pmax_t, need))).otherwise(F.lit(0.0))


def _battery_step(x: Column, p: Column, eta: Column, dt: Column) -> Column:
    return F.when(x >= 0, eta * dt * F.least(p, x)).otherwise(-dt * F.least(p, -x))


def _flows(soc: str, prev: str, eta: Column, dt: Column) -> tuple[Column, Column]:
    ds = col(soc) - col(prev)
    return F.greatest(ds, F.lit(0.0)) / (eta * dt), F.greatest(-ds, F.lit(0.0)) / dt


# ---------------------------------------------------------------------------
# D1 scheduled dispatch
# ---------------------------------------------------------------------------

def scheduled_dispatch(df: DataFrame, schedule_long: DataFrame | None = None, *, grid_on: bool = False,
                       keys: Sequence[str] = KEYS, cfg: Mapping[str, Any] | None = None) -> DataFrame:
    """Fixed-schedule battery run.

    ``df`` has an ``action`` column ('C', 'D', other = idle) or a long
    schedule ``(month, hour, action)`` is joined on the interval's month and
    hour (exact hour stamps only, J3).  Efficiency applies on charge; the
    state starts at 0.  With ``grid_on`` charging is limited by the POI instead
    of by generation, and unmet load is imported up to the POI.
    """
    keys = list(keys)
    df = _attach(df, cfg)
    if schedule_long is not None:
        from wattline.sources.schedule import align_schedule
        df = align_schedule(df, schedule_long)
    act = action_code(col("action"))
    dt, eta, p, poi = col("dt_hours"), col("rte"), col("battery_power_mw"), col("poi_limit_mw")
    d = df.withColumns({"schedule_action": act,
                        "gen": F.coalesce(col("wind_mw"), F.lit(0.0)) + F.coalesce(col("solar_mw"), F.lit(0.0))
                        + F.coalesce(col("natgas_mw"), F.lit(0.0)),
                        "_E": battery_energy_mwh()})
    lim = poi if grid_on else col("gen")
    step = (F.when(col("schedule_action") == "C", eta * dt * F.greatest(F.lit(0.0), F.least(p, lim)))
            .when(col("schedule_action") == "D",
                  -dt * F.greatest(F.lit(0.0), F.least(p, F.greatest(F.lit(0.0), poi - col("gen")))))
            .otherwise(F.lit(0.0)))
    d = d.withColumn("_pos", interval_position()).withColumn("_step", step)
    d = _attach(bounded_balance(_detach(d, cfg), keys, "_pos", "_step", 0.0, "_E", order=["ts"], out="soc1",
                                prev_out="soc1_prev").drop("_step"), cfg)
    ch, dis = _flows("soc1", "soc1_prev", eta, dt)
    d = d.withColumns({"charge1": ch, "discharge1": dis})
    d = d.withColumns({
        "serve": F.least(col("load_mw"), col("gen") + col("discharge1")),
        "grid_exp": F.least(F.greatest(F.lit(0.0), col("gen") + col("discharge1") - col("load_mw")), poi),
        "grid_imp": (F.least(F.greatest(F.lit(0.0), col("load_mw") - (col("gen") + col("discharge1"))), poi)
                     if grid_on else F.lit(0.0)),
    })
    d = d.withColumn("clipped", F.greatest(F.lit(0.0), col("gen") - (col("serve") + col("charge1"))))
    ng = F.coalesce(col("natgas_mw"), F.lit(0.0))
    d = d.withColumns({
        "generation": col("gen"), "load": col("load_mw"), "price_per_kwh": col("price") / 1000,
        "charge2": F.lit(0.0), "discharge2": F.lit(0.0), "charge": col("charge1"), "discharge": col("discharge1"),
        "gas_gen": ng, "unserved": col("load_mw") - col("serve"),
        "gas_on": F.when(ng > EPS_ON, 1.0).otherwise(0.0), "gas_start": F.lit(0.0), "gas_stop": F.lit(0.0),
        "gas_cost": F.lit(0.0), "soc2": F.lit(0.0), "soc": col("soc1"),
        "net_to_grid": col("grid_exp") - col("grid_imp"),
    })
    return d.drop("gen", "_E", "_pos", "soc1_prev", "action")


# ---------------------------------------------------------------------------
# D2-D4 serve-first dispatch
# ---------------------------------------------------------------------------

def serve_first_dispatch(df: DataFrame, *, grid_on: bool = False, two_battery: bool = False,
                         gas_charges_storage: bool = False, keys: Sequence[str] = KEYS,
                         gas_follow_ramp: bool = False, commitment: bool = False,
                         cfg: Mapping[str, Any] | None = None) -> DataFrame:
    """D2 (grid off) / D3 (grid on) with optional second battery (D4), ramp-limited gas and commitment.

    Battery 1 takes the surplus (charge) or covers the deficit (discharge)
    first; battery 2 works on what battery 1 leaves.  Dispatchable gas fills
    the remaining deficit between ``pmin_t`` and ``pmax_t`` when its marginal
    cost (variable + carbon) is below VOLL (grid off) or below the market
    price (grid on).  ``gas_charges_storage`` (grid off) lets spare gas
    capacity charge battery 1 when gas / eta + degradation < VOLL.

    With ``commitment`` a dispatchable unit that started runs for
    ``gas_min_up_h`` at least (at ``pmin_t`` where nothing is needed; the rest is
    exported or clipped), and rests for ``gas_min_down_h`` after it stopped.
    Then ``gas_on`` is the unit's status, also where its output is 0.
    """
    keys = list(keys)
    d = _derive(_attach(_with_gas_zero(_detach(df, cfg), keys, cfg), cfg), grid_on, gas_charges_storage)
    d = d.withColumns({"_E1": battery_energy_mwh(), "_pos": interval_position(),
                       "_a1": _battery_step(col("_x"), col("battery_power_mw"), col("rte"), col("dt_hours"))})
    direct = not (two_battery or gas_follow_ramp or commitment)
    nexts: list[DataFrame] = []  # all folds cut the rows alike
    d = bounded_balance(_detach(d, cfg).drop(*DERIVED), keys, "_pos", "_a1", 0.0, "_E1", order=["ts"], out="soc1",
                        prev_out="_s1p", prev2_out="_s1pp" if direct else None,
                        lagged=_lag_inputs(False) if direct else None, nexts=nexts).drop("_E1", "_a1")
    d = _derive(_attach(d, cfg), grid_on, gas_charges_storage)
    c1, d1 = _flows("soc1", "_s1p", col("rte"), col("dt_hours"))
    d = d.withColumns({"charge1": c1, "discharge1": d1})
    if two_battery:
        d = d.withColumns({"_E2": battery2_energy_mwh(), "_a2": _battery_step(
            col("_x") - col("charge1") + col("discharge1"), col("battery2_power_mw"), col("battery2_rte"), col("dt_hours"))})
        d = bounded_balance(_detach(d, cfg).drop(*DERIVED, "_s1p"), keys, "_pos", "_a2", 0.0, "_E2", order=["ts"],
                            out="soc2", prev_out="_s2p", prev2_out="_s2pp",
                            lagged=None if gas_follow_ramp or commitment else _lag_inputs(True),
                            nexts=nexts).drop("_E2", "_a2")
        d = _derive(_attach(d, cfg), grid_on, gas_charges_storage)
        c2, d2 = _flows("soc2", "_s2p", col("battery2_rte"), col("dt_hours"))
        d = d.withColumns({"charge2": c2, "discharge2": d2})
    else:
        d = d.withColumns({"charge2": F.lit(0.0), "discharge2": F.lit(0.0), "soc2": F.lit(0.0)})
    if gas_follow_ramp:
        d = _need(d, grid_on)
        d = gas_follow(d.drop("charge", "discharge"), keys, cfg, grid_on, gas_charges_storage, nexts)
    if commitment:
        d = gas_commit(d, keys, cfg, grid_on, gas_charges_storage, gas_follow_ramp, nexts)
    gas = "committed" if commitment else "followed" if gas_follow_ramp else "two" if two_battery else "one"
    return finish(d, grid_on=grid_on, gas=gas)


def _need(d: DataFrame, grid_on: bool) -> DataFrame:
    """Battery totals and the deficit that gas may fill."""
    d = d.withColumns({"charge": col("charge1") + col("charge2"), "discharge": col("discharge1") + col("discharge2")})
    need = F.greatest(F.lit(0.0), col("load_mw") + col("charge") - col("gen") - col("discharge"))
    ok = col("_gas_ok") & (marginal_gas_cost() < col("price")) if grid_on else col("_gas_ok")
    return d.withColumn("_need", F.when(ok, need).otherwise(F.lit(0.0)))


def finish(d: DataFrame, *, grid_on: bool, gas: str = "one") -> DataFrame:
    """The result columns from the battery flows, row by row.

    ``gas``: where the previous row's gas status comes from: its inputs with
    ``one`` or ``two`` batteries, the ramp fold that gave ``_gas_d`` and
    ``_on_prev`` (``followed``), or the commitment that gave ``_on`` too
    (``committed``).
    """
    poi, dt = col("poi_limit_mw"), col("dt_hours")
    d = _need(d, grid_on)
    if gas in ("one", "two"):
        d = d.withColumn("_gas_d", _gas_output(col("_need"), col("pmin_t"), col("pmax_t")))
    supply = col("gen") + col("_gas_d") + col("discharge") - col("charge")
    if grid_on:
        d = d.withColumns({
            "grid_imp": F.greatest(F.lit(0.0), col("load_mw") - supply),
            "_surplus": F.greatest(F.lit(0.0), supply - col("load_mw")),
        })
        d = d.withColumns({"grid_exp": F.least(poi, col("_surplus")), "serve": col("load_mw"),
                           "infeasible": col("grid_imp") > poi + F.lit(1e-9)})
        d = d.withColumn("clipped", col("_surplus") - col("grid_exp"))
    else:
        d = d.withColumns({"serve": F.least(col("load_mw"), supply), "grid_imp": F.lit(0.0),
                           "grid_exp": F.lit(0.0), "infeasible": F.lit(False)})
        d = d.withColumn("clipped", F.greatest(F.lit(0.0), supply - col("serve")))
    d = d.withColumns({
        "gas_gen": col("must_run") + col("_gas_d"),
        "generation": col("gen_ren") + col("must_run") + col("_gas_d"),
        "load": col("load_mw"), "price_per_kwh": col("price") / 1000,
        "unserved": col("load_mw") - col("serve"), "soc": col("soc1") + col("soc2"),
        "net_to_grid": col("grid_exp") - col("grid_imp"),
    })
    d = d.withColumn("gas_on", col("_on") if gas == "committed" else F.when(col("gas_gen") > EPS_ON, 1.0).otherwise(0.0))
    prev_on = F.coalesce(col("_on_prev") if gas in ("followed", "committed") else _previous_gas_on(grid_on, gas == "two"), F.lit(0.0))
    d = d.withColumns({
        "gas_start": F.when((col("gas_on") > 0) & (prev_on <= 0), 1.0).otherwise(0.0),
        "gas_stop": F.when(col("gas_disp") & (col("gas_on") <= 0) & (prev_on > 0), 1.0).otherwise(0.0),
    })
    d = d.withColumn("gas_cost", col("gas_gen") * gas_variable_cost() * dt
                     + col("gas_start") * col("gas_startup_cost_usd")
                     + col("gas_on") * gas_no_load_cost() * dt)
    return d.drop("_gas_ok", "_pos", "_x", "_need", "_gas_d", "_surplus", "_on", "_on_prev", "gen", "_ng_zero", "_s1p", "_s1pp",
                  "_s2p", "_s2pp", *_lag_inputs(True))


# ---------------------------------------------------------------------------
# D5 ramp-limited gas follow
# ---------------------------------------------------------------------------

def gas_follow(d: DataFrame, keys: Sequence[str], cfg: Mapping[str, Any] | None = None, grid_on: bool = False,
               gas_charges_storage: bool = False, nexts: list[DataFrame] | None = None) -> DataFrame:
    """Gas output follows the deficit ``_need`` within ramp limits, then lifts to pmin_t when on.

    Adds ``_gas_d`` and the previous row's status ``_on_prev``.  A lift to
    ``pmin_t`` may break a ramp limit; ``dispatch_audit`` reports it.
    """
    pmax = col("gas_pmax_mw")
    d = d.withColumns({"_ru": col("gas_ramp_up_mw_per_h") * col("dt_hours"),
                       "_rd": col("gas_ramp_down_mw_per_h") * col("dt_hours"), "_tg": F.least(col("pmax_t"), col("_need")),
                       "_top": F.when(pmax > 0, pmax).otherwise(F.lit(1e12)), "_m": col("must_run"),
                       "_lo": col("pmin_t"), "_hi": col("pmax_t")})
    thin = _detach(d, cfg).drop(*DERIVED, "_need")
    out = ramp_follow(thin, keys, col("_pos"), ["ts"], col("_tg"), col("_ru"), col("_rd"), col("_top"), "_gr", "_grp",
                      lagged={"_p_m": col("_m"), "_p_lo": col("_lo"), "_p_hi": col("_hi")}, nexts=nexts)
    out = _derive(_attach(out, cfg), grid_on, gas_charges_storage)
    lift = lambda g, lo, hi: F.when(g > EPS_ON, F.least(hi, F.greatest(lo, g))).otherwise(F.lit(0.0))
    before = col("_p_m") + lift(col("_grp"), col("_p_lo"), col("_p_hi"))
    return out.withColumns({
        "_gas_d": lift(col("_gr"), col("pmin_t"), col("pmax_t")),
        "_on_prev": F.when(before > EPS_ON, 1.0).when(before.isNotNull(), 0.0),
    }).drop("_ru", "_rd", "_tg", "_top", "_m", "_lo", "_hi", "_gr", "_grp", "_p_m", "_p_lo", "_p_hi")


def gas_commit(d: DataFrame, keys: Sequence[str], cfg: Mapping[str, Any] | None = None, grid_on: bool = False,
               gas_charges_storage: bool = False, followed: bool = False, nexts: list[DataFrame] | None = None) -> DataFrame:
    """D5 + W5: the unit runs when gas is wanted, within its minimum up and down times.

    Gas is wanted where the deficit (``followed``: the ramp-limited output
    ``_gas_d``) asks for some.  Adds the status ``_on``, the previous row's
    ``_on_prev`` and the output ``_gas_d``: between ``pmin_t`` and ``pmax_t`` when on,
    else 0.  Must-run gas is on where it has output.  Resting or lifted output
    may break a ramp limit; ``dispatch_audit`` reports it.
    """
    if not followed:
        d = _need(d, grid_on)
        d = d.withColumn("_gas_d", _gas_output(col("_need"), col("pmin_t"), col("pmax_t"))).drop("charge", "discharge")
    times = lambda c: F.when(col("gas_disp"), F.greatest(min_periods(c), F.lit(1))).otherwise(F.lit(1))
    d = d.withColumns({"_want": col("must_run") + col("_gas_d") > EPS_ON, "_up": times("gas_min_up_h"),
                       "_down": times("gas_min_down_h")})
    thin = _detach(d, cfg).drop(*DERIVED, "_need", "_on_prev")
    out = commit(thin, keys, col("_pos"), ["ts"], col("_want"), col("_up"), col("_down"), "_on", "_on_prev",
                 nexts=nexts)
    out = _derive(_attach(out, cfg), grid_on, gas_charges_storage)
    run = F.least(col("pmax_t"), F.greatest(col("pmin_t"), col("_gas_d")))
    return out.withColumn("_gas_d", F.when(col("gas_disp") & (col("_on") > 0), run).otherwise(F.lit(0.0))) \
        .drop("_want", "_up", "_down")
