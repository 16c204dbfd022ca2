"""Registered queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Every query reads the driver tables under ``sf_dir`` (through
``intervals_from_events``) so its work grows with the data.  The oracle SQL
re-states the same computation in DuckDB; numeric literals are written as
doubles so both engines do the same IEEE operations in the same order.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.config import full_config, with_config
from wattline.functions.clean import clean_intervals, date_window, interval_quality
from wattline.functions.profiles import hour_index, std_normal, synthetic_load
from wattline.operators.balance import bounded_balance
from wattline.operators.dispatch import interval_position, scheduled_dispatch
from wattline.operators.metrics import monthly_cycles, scheduled_metrics
from wattline.session import prepare_session
from wattline.sources.intervals import INTERVALS_SQL, intervals_from_events
from wattline.sources.schedule import align_schedule, default_schedule_wide, schedule_long, \
    _template_action

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def d(x: float) -> str:
    """A double literal for DuckDB."""
    if x == math.inf:
        return "CAST('inf' AS DOUBLE)"
    return f"CAST({float(x)!r} AS DOUBLE)"


def with_sql(body: str, select: str) -> str:
    return f"WITH RECURSIVE {INTERVALS_SQL.strip()},\n{body.strip()}\n{select.strip()}" if body.strip() else \
        f"WITH {INTERVALS_SQL.strip()}\n{select.strip()}"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_session(spark)
    return clean_intervals(intervals_from_events(spark, sf_dir))


# ---------------------------------------------------------------------------
# parameters of the single-site runs (our own demo values)
# ---------------------------------------------------------------------------
SITE_CFG = dict(base_load_mw=50.0, load_type="24-7", load_std=15.0, battery_power_mw=20.0,
                battery_duration_h=4.0, rte=0.86, poi_limit_mw=60.0, gas_enabled=True,
                gas_dispatchable=True, gas_pmax_mw=25.0, gas_pmin_mw=5.0, gas_var_cost_usd_per_mwh=30.0,
                gas_startup_cost_usd=100.0, gas_no_load_cost_usd_per_h=10.0, voll_usd_per_mwh=2000.0,
                bess_deg_cost_usd_per_mwh=3.0, carbon_price_usd_per_ton=20.0, dt_hours=1.0,
                battery2_power_mw=10.0, battery2_duration_h=2.0, battery2_rte=0.9,
                gas_ramp_up_mw_per_h=8.0, gas_ramp_down_mw_per_h=8.0)
BALANCE_CAP = 200.0
WINDOW = ("2024-01-08", "2024-01-21")


# ---------------------------------------------------------------------------
# Phase 1: clean, quality, window, synthetic load
# ---------------------------------------------------------------------------
IV_COLS = "site_id, ts, wind_mw, solar_mw, natgas_mw, load_mw, price"


@register("intervals_clean", with_sql("", f"SELECT {IV_COLS} FROM intervals"))
def q_intervals_clean(spark, sf_dir):
    """S1 stand-in + P2/P5/P7: the cleaned interval table."""
    return intervals(spark, sf_dir)


_Q_SQL = """
SELECT site_id, count(*) AS n_rows, CAST(count_if(ts IS NULL) AS BIGINT) AS n_bad_ts, min(ts) AS first_ts, max(ts) AS last_ts,
  CAST(count_if(wind_mw IS NULL) AS BIGINT) AS n_null_wind_mw, CAST(count_if(solar_mw IS NULL) AS BIGINT) AS n_null_solar_mw,
  CAST(count_if(natgas_mw IS NULL) AS BIGINT) AS n_null_natgas_mw, CAST(count_if(load_mw IS NULL) AS BIGINT) AS n_null_load_mw,
  CAST(count_if(price IS NULL) AS BIGINT) AS n_null_price,
  count(wind_mw) > 0 AS has_wind_mw, count(solar_mw) > 0 AS has_solar_mw, count(natgas_mw) > 0 AS has_natgas_mw,
  CAST(count(ts) - count(DISTINCT ts) AS BIGINT) AS n_repeated_ts,
  max(price) < 10 AS price_unit_warning,
  sum(abs(coalesce(load_mw, 0.0))) < 1e-9 AS load_all_zero,
  round(avg(coalesce(load_mw, 0.0)), 6) AS avg_load_mw, max(price) AS peak_price
FROM intervals GROUP BY site_id
"""


@register("interval_quality", with_sql("", _Q_SQL))
def q_interval_quality(spark, sf_dir):
    """One quality row per site."""
    prepare_session(spark)
    return interval_quality(intervals_from_events(spark, sf_dir))


@register("date_window", with_sql("", f"""
SELECT {IV_COLS} FROM intervals
WHERE ts >= TIMESTAMP '{WINDOW[0]} 00:00:00' AND ts < CAST(DATE '{WINDOW[1]}' + INTERVAL 1 DAY AS TIMESTAMP)"""))
def q_date_window(spark, sf_dir):
    """Two-week window, end day included whole."""
    prepare_session(spark)
    return date_window(clean_intervals(intervals_from_events(spark, sf_dir, WINDOW)), *WINDOW)


def _normal_sql(seed: int = 20240101) -> str:
    from wattline.functions.profiles import ROUNDS
    x = f"((CAST(floor(epoch(ts) / 3600) AS BIGINT) * 7919 + site_id * 104729 + {seed}) % 2147483647)"
    draws = []
    for c in ROUNDS:
        x = f"(({x} * {x} + {c}) % 2147483647)"
        draws.append(f"((CAST({x} AS DOUBLE) + {d(1.0)}) / {d(2147483648.0)})")
    return f"(sqrt({d(-2.0)} * ln({draws[1]})) * cos({d(2 * math.pi)} * {draws[3]}))"


_SYN_SQL = f"""
SELECT site_id, ts,
  {d(50.0)} AS load_24_7,
  CASE WHEN hour(ts) BETWEEN 7 AND 22 THEN {d(50.0)} ELSE {d(0.0)} END AS load_16_7,
  round(greatest({d(0.0)}, {d(50.0)} + {d(15.0)} * {_normal_sql()}), 6) AS load_random,
  round(CASE WHEN hour(ts) BETWEEN 7 AND 22 THEN {d(50.0)} + {d(15.0)} * {_normal_sql()} ELSE {d(0.0)} END, 6)
    AS load_random_16_7
FROM intervals
"""


@register("synthetic_load", with_sql("", _SYN_SQL))
def q_synthetic_load(spark, sf_dir):
    """the four synthetic load profiles on every interval (base 50 MW, std 15)."""
    iv = intervals(spark, sf_dir)
    b, s = F.lit(50.0), F.lit(15.0)
    mk = lambda t: synthetic_load(F.col("ts"), F.col("site_id"), F.lit(t), b, s)
    return iv.select("site_id", "ts", mk("24-7").alias("load_24_7"), mk("16-7").alias("load_16_7"),
                     F.round(mk("random"), 6).alias("load_random"),
                     F.round(mk("random_16-7"), 6).alias("load_random_16_7"))


# ---------------------------------------------------------------------------
# Phase 2: balance, schedule, scheduled dispatch and metrics
# ---------------------------------------------------------------------------

_BAL_SQL_BODY = f"""
x AS (SELECT site_id, ts, wind_mw + solar_mw + natgas_mw - load_mw AS a,
        row_number() OVER (PARTITION BY site_id ORDER BY ts) AS n FROM intervals),
r AS (SELECT site_id, n, {d(0.0)} AS soc0, least({d(BALANCE_CAP)}, greatest({d(0.0)}, {d(0.0)} + a)) AS soc
      FROM x WHERE n = 1
      UNION ALL
      SELECT x.site_id, x.n, r.soc, least({d(BALANCE_CAP)}, greatest({d(0.0)}, r.soc + x.a))
      FROM r JOIN x ON x.site_id = r.site_id AND x.n = r.n + 1)
"""


@register("bounded_balance", with_sql(_BAL_SQL_BODY, """
SELECT x.site_id, x.ts, x.a AS step, r.soc0 AS soc_prev, r.soc FROM x JOIN r ON r.site_id = x.site_id AND r.n = x.n"""))
def q_bounded_balance(spark, sf_dir):
    """Running balance of net generation per site, clamped to [0, 200]."""
    iv = intervals(spark, sf_dir)
    iv = iv.withColumns({"step": F.col("wind_mw") + F.col("solar_mw") + F.col("natgas_mw") - F.col("load_mw"),
                         "dt_hours": F.lit(1.0)})
    out = bounded_balance(iv.withColumn("_pos", interval_position()), ["site_id"], "_pos", "step", 0.0,
                          BALANCE_CAP, order=["ts"], out="soc", prev_out="soc_prev")
    return out.select("site_id", "ts", "step", "soc_prev", "soc")


def schedule_values_sql() -> str:
    rows = ", ".join(f"({m}, {h}, '{_template_action(m, h)}')" for m in range(1, 13) for h in range(24))
    return f"sched(month, hour, action) AS (VALUES {rows})"


@register("schedule_long", with_sql(schedule_values_sql(), """
SELECT i.site_id, i.ts, coalesce(s.action, '') AS action FROM intervals i
LEFT JOIN sched s ON s.month = CASE WHEN minute(i.ts) = 0 AND second(i.ts) = 0 THEN month(i.ts) END
  AND s.hour = hour(i.ts)"""))
def q_schedule_long(spark, sf_dir):
    """S5 + P21 + J3: template unpivoted to (month, hour, action) and aligned to every interval."""
    iv = intervals(spark, sf_dir)
    lng = schedule_long(default_schedule_wide(spark))
    return align_schedule(iv, lng).select("site_id", "ts", "action")


def d1_sql(cfg: dict, grid_on: bool = False) -> str:
    eta, dt, p, poi = d(cfg["rte"]), d(cfg["dt_hours"]), d(cfg["battery_power_mw"]), d(cfg["poi_limit_mw"])
    e = d(cfg["battery_power_mw"] * cfg["battery_duration_h"])
    lim = poi if grid_on else "gen"
    imp = f"least(greatest({d(0.0)}, load_mw - (gen + discharge1)), {poi})" if grid_on else d(0.0)
    return f"""{schedule_values_sql()},
x AS (SELECT i.*, coalesce(s.action, '') AS act, i.wind_mw + i.solar_mw + i.natgas_mw AS gen,
        row_number() OVER (PARTITION BY i.site_id ORDER BY i.ts) AS n
      FROM intervals i LEFT JOIN sched s
        ON s.month = CASE WHEN minute(i.ts) = 0 AND second(i.ts) = 0 THEN month(i.ts) END AND s.hour = hour(i.ts)),
y AS (SELECT *, CASE WHEN act = 'C' THEN {eta} * {dt} * greatest({d(0.0)}, least({p}, {lim}))
                      WHEN act = 'D' THEN (-{dt}) * greatest({d(0.0)}, least({p}, greatest({d(0.0)}, {poi} - gen)))
                      ELSE {d(0.0)} END AS a FROM x),
r AS (SELECT site_id, n, {d(0.0)} AS soc0, least({e}, greatest({d(0.0)}, {d(0.0)} + a)) AS soc FROM y WHERE n = 1
      UNION ALL
      SELECT y.site_id, y.n, r.soc, least({e}, greatest({d(0.0)}, r.soc + y.a))
      FROM r JOIN y ON y.site_id = r.site_id AND y.n = r.n + 1),
z AS (SELECT y.*, r.soc0, r.soc,
        greatest(r.soc - r.soc0, {d(0.0)}) / ({eta} * {dt}) AS charge1,
        greatest(-(r.soc - r.soc0), {d(0.0)}) / {dt} AS discharge1
      FROM y JOIN r ON r.site_id = y.site_id AND r.n = y.n),
dz AS (SELECT *, least(load_mw, gen + discharge1) AS serve,
         least(greatest({d(0.0)}, gen + discharge1 - load_mw), {poi}) AS grid_exp,
         {imp} AS grid_imp FROM z),
disp AS (SELECT *, greatest({d(0.0)}, gen - (serve + charge1)) AS clipped, load_mw - serve AS unserved FROM dz)
"""


D1_COLS = ["site_id", "ts", "schedule_action", "generation", "charge", "discharge", "soc", "serve",
           "grid_exp", "grid_imp", "clipped", "unserved"]


def _d1(spark, sf_dir):
    return scheduled_dispatch(intervals(spark, sf_dir), schedule_long(default_schedule_wide(spark)),
                              keys=["site_id"], cfg=SITE_CFG)


@register("scheduled_dispatch", with_sql(d1_sql(SITE_CFG), """
SELECT site_id, ts, act AS schedule_action, gen AS generation, charge1 AS charge, discharge1 AS discharge, soc,
  serve, grid_exp, grid_imp, clipped, unserved FROM disp"""))
def q_scheduled_dispatch(spark, sf_dir):
    """Default schedule, battery 20 MW x 4 h, grid off."""
    return _d1(spark, sf_dir).select(*D1_COLS)


from wattline.plans.sqlfrag import asdbl, dr, iround, isum  # noqa: E402


def dsum_sql(x: str) -> str:
    return isum(x)


def r2(x: str, n: int = 2) -> str:
    return iround(x, n)


@register("scheduled_metrics", with_sql(d1_sql(SITE_CFG) + f""",
g AS (SELECT site_id, {dsum_sql('charge1 * ' + d(1.0))} AS c, {dsum_sql('discharge1 * ' + d(1.0))} AS dis,
     {dsum_sql('load_mw * ' + d(1.0))} AS ld, {dsum_sql('serve * ' + d(1.0))} AS sv,
     {dsum_sql('grid_imp * ' + d(1.0))} AS imp, {dsum_sql('grid_exp * ' + d(1.0))} AS exp,
     {dsum_sql('(grid_exp - grid_imp) * price * ' + d(1.0))} AS rev,
     {dsum_sql('natgas_mw * ' + d(1.0))} AS ng, {dsum_sql('gen * ' + d(1.0))} AS gn
   FROM disp GROUP BY site_id)""", f"""
SELECT site_id, {r2('c')} AS total_charge_mwh, {r2('dis')} AS total_discharge_mwh,
  {dr(f"CASE WHEN {d(SITE_CFG['battery_power_mw'] * SITE_CFG['battery_duration_h'])} > 0 THEN {asdbl('dis')} / {d(SITE_CFG['battery_power_mw'] * SITE_CFG['battery_duration_h'])} ELSE {d(0.0)} END", 2)} AS cycles_battery1,
  {dr(f"CASE WHEN {asdbl('gn')} > 0 THEN 100 * {asdbl('c')} / {asdbl('gn')} ELSE {d(0.0)} END", 2)} AS shift_pct,
  {dr(f"{asdbl('c')} * (1 - {d(SITE_CFG['rte'])})", 2)} AS total_wastage_mwh,
  {r2('ld')} AS total_load_mwh, {r2('sv')} AS total_served_mwh, {r2('imp')} AS grid_imp_mwh,
  {r2('exp')} AS grid_exp_mwh, {r2('rev')} AS merchant_revenue_usd, {d(0.0)} AS natgas_total_cost_usd,
  {r2('ng')} AS total_natgas_mwh
FROM g"""))
def q_scheduled_metrics(spark, sf_dir):
    """A22 + A1/A2/A10-A12 per site for the scheduled run."""
    return scheduled_metrics(_d1(spark, sf_dir), keys=["site_id"])


@register("monthly_cycles", with_sql(d1_sql(SITE_CFG) + f""",
g AS (SELECT site_id, strftime(ts, '%Y-%m') AS month, {dsum_sql('discharge1 * ' + d(1.0))} AS dis
      FROM disp GROUP BY site_id, strftime(ts, '%Y-%m'))""", f"""
SELECT site_id, month, {dr(f"{asdbl('dis')} / {d(SITE_CFG['battery_power_mw'] * SITE_CFG['battery_duration_h'])}", 2)} AS cycles FROM g"""))
def q_monthly_cycles(spark, sf_dir):
    """Discharge cycles per site and calendar month (long form)."""
    return monthly_cycles(_d1(spark, sf_dir), keys=["site_id"])


# ---------------------------------------------------------------------------
# Phase 3: reference MW, scaling, gas caps, serve-first dispatch
# ---------------------------------------------------------------------------
from wattline.operators.dispatch import gas_cap, must_run_gas, prepare, scale_renewables, \
    serve_first_dispatch  # noqa: E402
from wattline.operators.metrics import run_metrics  # noqa: E402
from wattline.plans.dispatch_sql import serve_first_sql, run_metrics_sql  # noqa: E402
from wattline.plans.sweep import reference_mw  # noqa: E402


_REF_SQL = f"""ref AS (SELECT site_id,
  coalesce(CAST(ceil(max(greatest(solar_mw, {d(0.0)}))) AS DOUBLE), {d(0.0)}) AS ref_solar_mw,
  coalesce(CAST(ceil(max(greatest(wind_mw, {d(0.0)}))) AS DOUBLE), {d(0.0)}) AS ref_wind_mw
  FROM intervals GROUP BY site_id)"""


@register("reference_mw", with_sql(_REF_SQL, "SELECT * FROM ref"))
def q_reference_mw(spark, sf_dir):
    """Solar / wind reference MW per site."""
    return reference_mw(intervals(spark, sf_dir))


CAND_SOLAR, CAND_WIND = 80.0, 50.0


@register("scale_renewables", with_sql(_REF_SQL, f"""
SELECT i.site_id, i.ts,
  CASE WHEN r.ref_solar_mw > 0 THEN i.solar_mw * ({d(CAND_SOLAR)} / r.ref_solar_mw) ELSE {d(0.0)} END AS solar_mw,
  CASE WHEN r.ref_wind_mw > 0 THEN i.wind_mw * ({d(CAND_WIND)} / r.ref_wind_mw) ELSE {d(0.0)} END AS wind_mw
FROM intervals i JOIN ref r ON r.site_id = i.site_id"""))
def q_scale_renewables(spark, sf_dir):
    """Solar scaled to an 80 MW build, wind to 50 MW, by each site's reference MW."""
    iv = intervals(spark, sf_dir)
    j = iv.join(reference_mw(iv), "site_id").withColumns({"cand_solar_mw": F.lit(CAND_SOLAR),
                                                         "cand_wind_mw": F.lit(CAND_WIND)})
    return scale_renewables(j, F.col("ref_solar_mw"), F.col("ref_wind_mw")).select("site_id", "ts", "solar_mw",
                                                                                   "wind_mw")


_CAP_CFGS = {"static": dict(gas_pmax_mw=25.0, gas_use_profile_as_cap=False),
             "profile": dict(gas_pmax_mw=0.0, gas_use_profile_as_cap=True),
             "profile_pmax": dict(gas_pmax_mw=25.0, gas_use_profile_as_cap=True)}


def _cap_sql(pmax: float, use: bool) -> str:
    ng = f"greatest({d(0.0)}, coalesce(natgas_mw, {d(0.0)}))"
    if pmax > 0 and not use:
        return d(pmax)
    if use:
        return f"least({ng}, {d(pmax)})" if pmax > 0 else ng
    return d(pmax)


@register("gas_cap", with_sql("", f"""
SELECT site_id, ts, {_cap_sql(25.0, False)} AS cap_static, {_cap_sql(0.0, True)} AS cap_profile,
  {_cap_sql(25.0, True)} AS cap_profile_pmax,
  greatest({d(0.0)}, least({d(25.0)}, {_cap_sql(25.0, True)})) AS pmax_t,
  least(greatest({d(0.0)}, {d(5.0)}), greatest({d(0.0)}, least({d(25.0)}, {_cap_sql(25.0, True)}))) AS pmin_t
FROM intervals"""))
def q_gas_cap(spark, sf_dir):
    """P14 + P16: gas cap per interval for a static cap, the profile, and least(profile, pmax)."""
    iv = with_config(intervals(spark, sf_dir), SITE_CFG)
    out = iv
    for name, over in _CAP_CFGS.items():
        out = out.withColumns({k: F.lit(v) for k, v in over.items()}).withColumn(f"cap_{name}", gas_cap())
    p = prepare(out.select(*INTERVAL_FIELDS, *[c for c in out.columns if c not in INTERVAL_FIELDS]), ["site_id"])
    return p.select("site_id", "ts", "cap_static", "cap_profile", "cap_profile_pmax", "pmax_t", "pmin_t")


INTERVAL_FIELDS = ["site_id", "ts", "wind_mw", "solar_mw", "natgas_mw", "load_mw", "price"]


def q_must_run_gas(spark, sf_dir):
    """Must-run gas per interval: enabled with pmax, enabled profile-only, disabled, dispatchable."""
    iv = with_config(intervals(spark, sf_dir), SITE_CFG)
    zero = iv.groupBy("site_id").agg((F.sum(F.greatest(F.lit(0.0), F.coalesce(F.col("natgas_mw"), F.lit(0.0))))
                                      <= F.lit(1e-9)).alias("ng_zero"))
    j = iv.join(zero, "site_id")
    cases = {"must_run_pmax": dict(gas_enabled=True, gas_dispatchable=False, gas_pmax_mw=25.0),
             "must_run_profile": dict(gas_enabled=True, gas_dispatchable=False, gas_pmax_mw=0.0),
             "must_run_disabled": dict(gas_enabled=False, gas_dispatchable=False, gas_pmax_mw=25.0),
             "must_run_dispatchable": dict(gas_enabled=True, gas_dispatchable=True, gas_pmax_mw=25.0)}
    for name, over in cases.items():
        j = j.withColumns({k: F.lit(v) for k, v in over.items()}).withColumn(name, must_run_gas(F.col("ng_zero")))
    return j.select("site_id", "ts", *cases)


REGISTRY["must_run_gas"] = (q_must_run_gas, with_sql(f"""zq AS (SELECT site_id, sum(greatest({d(0.0)}, coalesce(natgas_mw, {d(0.0)}))) <= 1e-9 AS ng_zero FROM intervals GROUP BY site_id)""", f"""
SELECT i.site_id, i.ts,
  CASE WHEN z.ng_zero THEN {d(25.0)} ELSE least(greatest({d(0.0)}, coalesce(natgas_mw, {d(0.0)})), {d(25.0)}) END AS must_run_pmax,
  greatest({d(0.0)}, coalesce(natgas_mw, {d(0.0)})) AS must_run_profile,
  greatest({d(0.0)}, coalesce(natgas_mw, {d(0.0)})) AS must_run_disabled,
  {d(0.0)} AS must_run_dispatchable
FROM intervals i JOIN zq z ON z.site_id = i.site_id"""))

DISP_COLS = ["site_id", "ts", "charge", "discharge", "soc", "gas_gen", "serve", "unserved", "clipped", "grid_imp",
             "grid_exp", "gas_on", "gas_start", "gas_stop", "gas_cost", "generation"]


def _sf(spark, sf_dir, cfg=None, **kw):
    return serve_first_dispatch(intervals(spark, sf_dir), keys=["site_id"], cfg=cfg or SITE_CFG, **kw)


def _disp_sql(cols, **kw):
    return with_sql(serve_first_sql(SITE_CFG, **kw), f"SELECT {', '.join(cols)} FROM disp")


@register("dispatch_gridoff", _disp_sql(DISP_COLS))
def q_dispatch_gridoff(spark, sf_dir):
    """Serve-first dispatch, grid off, battery 20 MW x 4 h, dispatchable gas 5..25 MW."""
    return _sf(spark, sf_dir).select(*DISP_COLS)


@register("dispatch_gridon", _disp_sql(DISP_COLS + ["infeasible"], grid_on=True))
def q_dispatch_gridon(spark, sf_dir):
    """D3: full-serve dispatch, grid on (POI 60 MW), gas only when cheaper than the market."""
    return _sf(spark, sf_dir, grid_on=True).select(*DISP_COLS, "infeasible")


TWO_COLS = DISP_COLS + ["charge1", "discharge1", "soc1", "charge2", "discharge2", "soc2"]


@register("two_battery", _disp_sql(TWO_COLS, two_battery=True))
def q_two_battery(spark, sf_dir):
    """Second battery (10 MW x 2 h, 90 %) runs on what battery 1 leaves."""
    return _sf(spark, sf_dir, two_battery=True).select(*TWO_COLS)


@register("gas_follow", _disp_sql(DISP_COLS, ramp=True))
def q_gas_follow(spark, sf_dir):
    """Gas follows the deficit within 8 MW/h ramps, lifted to pmin when on."""
    return _sf(spark, sf_dir, gas_follow_ramp=True).select(*DISP_COLS)


def q_run_metrics(spark, sf_dir):
    """Run metrics of the grid-off dispatch per site."""
    return run_metrics(_sf(spark, sf_dir), keys=["site_id"])


def _metrics_sql(**kw):
    body = serve_first_sql(SITE_CFG, **kw)
    m = run_metrics_sql(SITE_CFG, grid_allowed=kw.get("grid_on", False))
    g, sel = m.split("\nSELECT", 1)
    return with_sql(body + g, "SELECT" + sel)


REGISTRY["run_metrics"] = (q_run_metrics, _metrics_sql())


# ---------------------------------------------------------------------------
# Phase 4: windows over dispatch tables, scorecard, audit, reasons, charts
# ---------------------------------------------------------------------------
from wattline.operators.audit import AUDIT_RULES, GAS_REASONS, MODES, chart_series, dispatch_audit, \
    commitment_columns, gas_commitment, gas_reasons, objective_scorecard  # noqa: E402
from wattline.operators.metrics import metrics_long  # noqa: E402
from wattline.plans.dispatch_sql import gas_constants  # noqa: E402

AUDIT_CFG = dict(SITE_CFG, gas_min_up_h=2, gas_min_down_h=3)
W_SITE = "OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _dec_cum(x: str) -> str:
    return dr(f"sum({x}) {W_SITE}", 2)


@register("cumulative_revenue", with_sql(serve_first_sql(SITE_CFG), f"""
SELECT site_id, ts, (grid_exp - grid_imp) * price AS merchant,
  {_dec_cum('(grid_exp - grid_imp) * price')} AS cum_merchant, {_dec_cum('gas_cost')} AS cum_gas_cost,
  {_dec_cum('(grid_exp - grid_imp) * price - gas_cost')} AS cum_net_revenue
FROM disp"""))
def q_cumulative_revenue(spark, sf_dir):
    """Cumulative merchant value, gas cost and net revenue per site (grid-off dispatch)."""
    cs = chart_series(_sf(spark, sf_dir), keys=["site_id"], columns=["price", "grid_net"])
    return cs.select("site_id", "ts", (F.col("grid_net") * F.col("price")).alias("merchant"),
                     "cum_merchant", "cum_gas_cost", "cum_net_revenue")


def _audit_disp(spark, sf_dir):
    return serve_first_dispatch(intervals(spark, sf_dir), keys=["site_id"], cfg=AUDIT_CFG)


_GS_SQL = f"""
SELECT site_id, ts, gas_gen, gas_on, gas_start, gas_stop,
  lag(gas_gen) OVER w AS gas_prev,
  gas_on - coalesce(lag(gas_on) OVER w, {d(0.0)}) AS on_change,
  abs(gas_gen - lag(gas_gen) OVER w) AS ramp_step,
  sum(gas_start) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS starts_in_min_up,
  sum(gas_stop) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS stops_in_min_down
FROM disp WINDOW w AS (PARTITION BY site_id ORDER BY ts)"""
GS_COLS = ["site_id", "ts", "gas_gen", "gas_on", "gas_start", "gas_stop", "gas_prev", "on_change", "ramp_step",
           "starts_in_min_up", "stops_in_min_down"]


@register("gas_starts", with_sql(serve_first_sql(AUDIT_CFG), _GS_SQL))
def q_gas_starts(spark, sf_dir):
    """Gas on/start/stop, ramp step and starts/stops inside min-up 2 h / min-down 3 h windows."""
    return gas_commitment(commitment_columns(_audit_disp(spark, sf_dir), ["site_id"]), keys=["site_id"]).select(*GS_COLS)


def _scorecard_sql(cfg: dict, lam: float = 0.9) -> str:
    k = gas_constants(cfg)
    c = k["c"]
    dt = d(c["dt_hours"])

    def ds(x):
        return isum(x)
    g = f"""sc AS (SELECT site_id, {ds(f'price * (grid_exp - grid_imp) * {dt}')} AS grid,
  {ds(f"{d(c['value_per_mwh'])} * serve * {dt}")} AS res, {ds(f'price * clipped * {dt}')} AS clip,
  {ds(f'gas_gen * {dt}')} AS gas, sum(gas_start) AS starts, sum(gas_on) AS onn,
  {ds(f'(discharge1 + discharge2) * {dt}')} AS dis, {ds(f'unserved * {dt}')} AS uns, {ds(f'serve * {dt}')} AS served,
  max(price) AS pmax FROM disp GROUP BY site_id)"""
    x = lambda n: asdbl(n)
    gas_cost = f"({d(k['var'])} * {x('gas')} + {d(c['gas_startup_cost_usd'])} * starts)"
    L, one_m = d(lam), f"({d(1.0)} - {d(lam)})"
    vals = {
        "blend": f"{L} * {x('res')} + {one_m} * {x('grid')} - {gas_cost}",
        "resilience": f"{d(1e6)} * {x('res')} + {x('clip')} - {gas_cost}",
        "revenue": f"{x('grid')} - {gas_cost}",
        "resilience_first_blend": f"{L} * (pmax * {x('served')}) + {one_m} * {x('grid')} - {gas_cost}",
        "grid_on_max_revenue": f"{x('grid')} - {gas_cost}",
        "cost_min_gridoff": (f"{d(c['voll_usd_per_mwh'])} * {x('uns')} + {d(k['var'])} * {x('gas')} "
                             f"+ {d(k['noload'])} * onn * {dt} + {d(c['gas_startup_cost_usd'])} * starts "
                             f"+ {d(c['bess_deg_cost_usd_per_mwh'])} * {x('dis')} "
                             f"+ {d(c['carbon_price_usd_per_ton'])} * {d(k['co2r'])} * {x('gas')} - {x('grid')}"),
    }
    sel = ", ".join(f"{dr(v, 2)} AS {n}" for n, v in vals.items())
    return g + f""",
wide AS (SELECT site_id, {sel} FROM sc)""", f"""
SELECT site_id, mode, value FROM (UNPIVOT wide ON {', '.join(MODES)} INTO NAME mode VALUE value)"""


_sc_body, _sc_sel = _scorecard_sql(SITE_CFG)


@register("objective_scorecard", with_sql(serve_first_sql(SITE_CFG) + ",\n" + _sc_body, _sc_sel))
def q_objective_scorecard(spark, sf_dir):
    """Value of each of the six dispatch objectives for the grid-off dispatch, per site."""
    return objective_scorecard(_sf(spark, sf_dir), keys=["site_id"])


def _audit_sql(cfg: dict) -> tuple[str, str]:
    c = full_config(cfg)
    dt, eps = d(c["dt_hours"]), "1e-6"
    e1, e2 = c["battery_power_mw"] * c["battery_duration_h"], c["battery2_power_mw"] * c["battery2_duration_h"]
    disp = "true" if (c["gas_enabled"] and c["gas_dispatchable"]) else "false"
    nup = math.ceil(c["gas_min_up_h"] / c["dt_hours"]) if c["gas_min_up_h"] > 0 else 0
    ndn = math.ceil(c["gas_min_down_h"] / c["dt_hours"]) if c["gas_min_down_h"] > 0 else 0
    su = f"sum(gas_start) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN {nup - 1} PRECEDING AND CURRENT ROW)" \
        if nup > 0 else d(0.0)
    sd = f"sum(gas_stop) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN {ndn - 1} PRECEDING AND CURRENT ROW)" \
        if ndn > 0 else d(0.0)
    body = f"""au AS (SELECT *, coalesce(lag(soc1) OVER w, {d(0.0)}) AS s1p, coalesce(lag(soc2) OVER w, {d(0.0)}) AS s2p,
   lag(gas_gen) OVER w AS gas_prev, {su} AS su, {sd} AS sd FROM disp WINDOW w AS (PARTITION BY site_id ORDER BY ts)),
ag AS (SELECT site_id,
  count_if(abs(generation + discharge1 + discharge2 + grid_imp - serve - charge1 - charge2 - grid_exp - clipped) > {eps}) AS power_balance,
  count_if(abs(grid_exp - grid_imp) > {d(0.0)} + {eps}) AS poi_limit,
  count_if((abs(soc1 - s1p - (charge1 * {d(c['rte'])} - discharge1) * {dt}) > {eps})
        OR (abs(soc2 - s2p - (charge2 * {d(c['battery2_rte'])} - discharge2) * {dt}) > {eps})) AS soc_step,
  count_if((soc1 < -{eps}) OR (soc1 > {d(e1)} + {eps}) OR (soc2 < -{eps}) OR (soc2 > {d(e2)} + {eps})) AS soc_bounds,
  count_if((discharge1 * {dt} > s1p + {eps}) OR (discharge2 * {dt} > s2p + {eps})) AS discharge_le_soc,
  count_if(abs(serve + unserved - load) > {eps}) AS served_plus_unserved,
  count_if({disp} AND ((gas_gen > pmax_t * gas_on + {eps}) OR (gas_gen < pmin_t * gas_on - {eps}))) AS gas_bounds,
  count_if(gas_prev IS NOT NULL AND (gas_gen - gas_prev > {d(c['gas_ramp_up_mw_per_h'])} * {dt} + {eps})) AS ramp_up,
  count_if(gas_prev IS NOT NULL AND (gas_prev - gas_gen > {d(c['gas_ramp_down_mw_per_h'])} * {dt} + {eps})) AS ramp_down,
  count_if({disp} AND {c['gas_min_up_h']} > 0 AND (su > gas_on + {eps})) AS min_up,
  count_if({disp} AND {c['gas_min_down_h']} > 0 AND (sd > {d(1.0)} - gas_on + {eps})) AS min_down,
  0 AS min_served_floor
  FROM au GROUP BY site_id),
agl AS (SELECT site_id, {', '.join(f'CAST({r} AS BIGINT) AS {r}' for r in AUDIT_RULES)} FROM ag)"""
    sel = f"SELECT site_id, rule, violations FROM (UNPIVOT agl ON {', '.join(AUDIT_RULES)} INTO NAME rule VALUE violations)"
    return body, sel


_au_body, _au_sel = _audit_sql(AUDIT_CFG)


@register("dispatch_audit", with_sql(serve_first_sql(AUDIT_CFG) + ",\n" + _au_body, _au_sel))
def q_dispatch_audit(spark, sf_dir):
    """Per site and rule, rows of the grid-off dispatch breaking it (min up 2 h, min down 3 h)."""
    return dispatch_audit(_audit_disp(spark, sf_dir), keys=["site_id"])


REASON_CFG = dict(SITE_CFG, gas_pmax_mw=0.0, gas_use_profile_as_cap=True)


def _reason_sql(cfg: dict) -> tuple[str, str]:
    c = full_config(cfg)
    dt = d(c["dt_hours"])
    r = GAS_REASONS
    en, disp, use = c["gas_enabled"], c["gas_dispatchable"], c["gas_use_profile_as_cap"]
    conds = [(f"{d(c['gas_pmax_mw'])} <= 0", r["no_capacity"]), ("false" if disp else "true", r["not_dispatchable"]),
             (f"{'true' if use else 'false'} AND colsum <= 1e-9", r["zero_profile_cap"]),
             ("ld > 0 AND sv >= ld - 1e-6", r["load_met"])]
    listed = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {a} THEN '{m}' END" for a, m in conds) + ")"
    en_s = "true" if en else "false"
    body = f"""rs AS (SELECT site_id, {iround(isum(f'gas_gen * {dt}'), 2)} AS ng,
   {iround(isum(f'serve * {dt}'), 2)} AS sv,
   {iround(isum(f'load * {dt}'), 2)} AS ld,
   sum(greatest({d(0.0)}, coalesce(natgas_mw, {d(0.0)}))) AS colsum FROM disp GROUP BY site_id)"""
    sel = f"""SELECT site_id, ng > 1e-6 AS gas_ran,
  CASE WHEN ng > 1e-6 THEN '' WHEN NOT {en_s} THEN '{r['disabled']}'
       WHEN {listed} = '' THEN '{r['uneconomic']}' ELSE {listed} END AS reasons,
  (ng <= 1e-6) AND (greatest(ld - sv, {d(0.0)}) > 1e-6)
    AND (NOT {en_s} OR ({d(c['gas_pmax_mw'])} <= 0) OR ({en_s} AND NOT {'true' if disp else 'false'} AND colsum <= 1e-9))
    AS no_firming_warning
FROM rs"""
    return body, sel


_rs_body, _rs_sel = _reason_sql(REASON_CFG)


@register("gas_reasons", with_sql(serve_first_sql(REASON_CFG) + ",\n" + _rs_body, _rs_sel))
def q_gas_reasons(spark, sf_dir):
    """Why gas produced nothing, per site, with gas capped by the (sparse) gas column."""
    disp = _sf(spark, sf_dir, cfg=REASON_CFG)
    m = run_metrics(disp, keys=["site_id"], also={
        "gas_column_sum": F.greatest(F.lit(0.0), F.coalesce(F.col("natgas_mw"), F.lit(0.0)))}).select(
            "site_id", "total_natgas_mwh", "total_served_mwh", "total_load_mwh", "gas_column_sum")
    return gas_reasons(with_config(m, REASON_CFG), keys=["site_id"]).withColumn(
        "reasons", F.array_join("reasons", " | "))


CHART_COLS = ["site_id", "ts", "solar_mw", "wind_mw", "natgas_mw", "battery1_net", "battery2_net", "grid_net", "load",
              "poi_line", "soc1", "soc2", "clipped", "cum_merchant", "cum_gas_cost", "cum_net_revenue"]


@register("chart_series", with_sql(serve_first_sql(dict(SITE_CFG)), f"""
SELECT site_id, ts, solar_mw, wind_mw, gas_gen AS natgas_mw, discharge1 - charge1 AS battery1_net,
  discharge2 - charge2 AS battery2_net, grid_exp - grid_imp AS grid_net, load, {d(SITE_CFG['poi_limit_mw'])} AS poi_line,
  soc1, soc2, clipped, {_dec_cum('(grid_exp - grid_imp) * price')} AS cum_merchant, {_dec_cum('gas_cost')} AS cum_gas_cost,
  {_dec_cum('(grid_exp - grid_imp) * price - gas_cost')} AS cum_net_revenue
FROM disp"""))
def q_chart_series(spark, sf_dir):
    """Chart data (sources, battery nets, grid, POI line, SOC, cumulative money) per site."""
    return chart_series(_sf(spark, sf_dir), keys=["site_id"]).select(*CHART_COLS)


def _metrics_long_sql():
    body = serve_first_sql(SITE_CFG)
    m = run_metrics_sql(SITE_CFG)
    g, sel = m.split("\nSELECT", 1)
    num = ["firmness_pct", "total_gen_over_load_pct", "renewable_gen_over_load_pct", "merchant_revenue_usd",
           "total_charge_mwh", "total_clip_mwh", "total_gen_mwh", "total_load_mwh", "total_served_mwh",
           "unserved_energy_mwh", "grid_imp_mwh", "grid_exp_mwh", "cycles_battery1", "cycles_battery2",
           "total_wind_mwh", "total_solar_mwh", "total_natgas_mwh", "natgas_start_count",
           "natgas_capacity_factor_pct", "natgas_total_cost_usd", "co2_tons", "total_operating_cost_usd",
           "cost_unserved_usd", "cost_gas_var_usd", "cost_gas_no_load_usd", "cost_gas_startup_usd",
           "cost_bess_deg_usd", "cost_carbon_usd", "horizon_hours", "dt_hours", "clipped_revenue_usd"]
    casted = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in num)
    return with_sql(body + g + ",\nmet AS (SELECT" + sel + f"),\nmc AS (SELECT site_id, {casted} FROM met)",
                    f"SELECT site_id, metric, value FROM (UNPIVOT mc ON {', '.join(num)} INTO NAME metric VALUE value)")


@register("metrics_long", _metrics_long_sql())
def q_metrics_long(spark, sf_dir):
    """Run metrics of the grid-off dispatch as (site, metric, value) rows."""
    return metrics_long(run_metrics(_sf(spark, sf_dir), keys=["site_id"]), keys=["site_id"])


# ---------------------------------------------------------------------------
# Phases 5-6: candidate grid, configuration, economics, sweep, ranking
# ---------------------------------------------------------------------------
from wattline.config import derived_config  # noqa: E402
from wattline.functions.econ import annualized_cost  # noqa: E402
from wattline.functions.text import money_text  # noqa: E402
from wattline.plans import sweep as SW  # noqa: E402
from wattline.plans import sweep_sql as SQ  # noqa: E402

SWEEP_BASE = dict(base_load_mw=50.0, load_type="16-7", load_std=15.0, battery_power_mw=20.0,
                  battery_duration_h=4.0, rte=0.86, poi_limit_mw=50.0, voll_usd_per_mwh=2000.0,
                  bess_deg_cost_usd_per_mwh=3.0, dt_hours=1.0)
SWEEP_RANGES = {"solar": dict(mode="multipliers", values=[0.5, 1.0, 1.5], reference_mw=None),
                "wind": dict(mode="pinned", values=[0.0], reference_mw=None),
                "bess_power": dict(mode="absolute", values=[10.0, 20.0, 40.0], reference_mw=None),
                "bess_duration": dict(mode="absolute", values=[2.0, 4.0], reference_mw=None),
                "gas": dict(mode="absolute", values=[0.0, 10.0, 25.0], reference_mw=None)}
TARGET_PCT = 60.0


def _grid(spark, sf_dir):
    return SW.candidate_grid(SW.reference_mw(intervals(spark, sf_dir)), SWEEP_RANGES)


def _grid_sql_select(cols: str) -> str:
    return with_sql(SQ.candidates_sql(SWEEP_RANGES), cols)


@register("candidate_grid", _grid_sql_select(
    "SELECT c.site_id, c.candidate_id, c.solar_mw, c.wind_mw, c.bess_power_mw, c.bess_duration_h, c.gas_mw, "
    "CAST(g.gs AS BIGINT) AS grid_size FROM cand c JOIN (SELECT site_id, "
    "greatest(len(v_solar_mw), 1) * greatest(len(v_wind_mw), 1) * greatest(len(v_bess_power_mw), 1) * "
    "greatest(len(v_bess_duration_h), 1) * greatest(len(v_gas_mw), 1) AS gs FROM g0) g ON g.site_id = c.site_id"))
def q_candidate_grid(spark, sf_dir):
    """J1 + F12: per site, the product of the five resolved ranges (solar as multipliers of the site's reference)."""
    return _grid(spark, sf_dir)


DERIVED_BASE = dict(SWEEP_BASE, gas_cost_mode="advanced", gas_vom_usd_per_mwh=2.0, gas_no_load_cost_usd_per_h=10.0)


def _cand_cfg(spark, sf_dir, base):
    cands, cfg = SW.candidate_config(_grid(spark, sf_dir), base)
    return with_config(cands, cfg, skip_existing=True)


@register("config_derived", _grid_sql_select(f"""
SELECT site_id, candidate_id, bess_power_mw * bess_duration_h AS battery_energy_mwh,
  {d(0.0)} * {d(0.0)} AS battery2_energy_mwh,
  CASE WHEN NOT (gas_mw > 0) THEN {d(0.0)} ELSE {d(7.5)} * {d(3.5)} + {d(2.0)} END AS gas_variable_cost_usd_per_mwh,
  CASE WHEN gas_mw > 0 THEN {d(10.0)} ELSE {d(0.0)} END AS effective_no_load_cost_usd_per_h,
  CASE WHEN NOT (gas_mw > 0) THEN {d(0.0)} ELSE {d(0.10)} * ({d(7.5)} * {d(3.5)}) END AS suggested_no_load_cost_usd_per_h,
  CASE WHEN gas_mw > 0 THEN {d(7.5)} * {d(0.05306)} ELSE {d(0.0)} END AS gas_co2_tons_per_mwh
FROM cand"""))
def q_config_derived(spark, sf_dir):
    """P22 + F15: derived values of every candidate configuration (advanced gas cost mode)."""
    return derived_config(_cand_cfg(spark, sf_dir, DERIVED_BASE)).select(
        "site_id", "candidate_id", "battery_energy_mwh", "battery2_energy_mwh", "gas_variable_cost_usd_per_mwh",
        "effective_no_load_cost_usd_per_h", "suggested_no_load_cost_usd_per_h", "gas_co2_tons_per_mwh")


ANN_COLS = ["annualized_solar_usd", "annualized_wind_usd", "annualized_bess_power_usd", "annualized_bess_energy_usd",
            "annualized_gas_usd", "fixed_om_solar_usd_yr", "fixed_om_wind_usd_yr", "fixed_om_bess_usd_yr",
            "fixed_om_gas_usd_yr", "annualized_total_usd_yr", "fixed_om_total_usd_yr"]


def _ann_sql() -> str:
    full = SQ.sweep_sql(SWEEP_BASE, SWEEP_RANGES)
    return with_sql(full, f"SELECT site_id, candidate_id, {', '.join(ANN_COLS)} FROM e2 JOIN (SELECT site_id AS s_, "
                    f"candidate_id AS c_, fixed_om_solar_usd_yr + fixed_om_wind_usd_yr + fixed_om_bess_usd_yr + "
                    f"fixed_om_gas_usd_yr AS fixed_om_total_usd_yr FROM e2) t ON t.s_ = e2.site_id AND t.c_ = e2.candidate_id")


@register("annualized_cost", _ann_sql())
def q_annualized_cost(spark, sf_dir):
    """F1 + F2: annualised capex and fixed O&M per candidate (default economics)."""
    from wattline.functions.econ import with_econ
    g = _grid(spark, sf_dir).withColumns({"bess_energy_mwh": F.col("bess_power_mw") * F.col("bess_duration_h")})
    return annualized_cost(with_econ(g, None)).select("site_id", "candidate_id", *ANN_COLS)


def _sweep(spark, sf_dir):
    return SW.capacity_sweep(intervals(spark, sf_dir), SWEEP_BASE, SWEEP_RANGES)


_SWEEP_SQL = SQ.sweep_sql(SWEEP_BASE, SWEEP_RANGES)


@register("capacity_sweep", with_sql(_SWEEP_SQL, "SELECT * FROM sweep"))
def q_capacity_sweep(spark, sf_dir):
    """Every (site, candidate) dispatched for the whole horizon, with metrics and economics."""
    return _sweep(spark, sf_dir)


_RANK_SQL = _SWEEP_SQL + ",\n" + SQ.ranked_sql(TARGET_PCT)


@register("ranked", with_sql(_RANK_SQL, "SELECT * FROM ranked"))
def q_ranked(spark, sf_dir):
    """P25 + W7 + T1: reliability and Pareto flags and rank per site (target 60 %)."""
    return SW.score_and_rank(_sweep(spark, sf_dir), TARGET_PCT)


@register("pareto", with_sql(_RANK_SQL, """
SELECT site_id, candidate_id, firmness_pct, total_annual_cost_usd FROM ranked WHERE is_pareto"""))
def q_pareto(spark, sf_dir):
    """The firmness / cost frontier per site."""
    r = SW.score_and_rank(_sweep(spark, sf_dir), TARGET_PCT)
    return SW.pareto_frontier(r).select("site_id", "candidate_id", "firmness_pct", "total_annual_cost_usd")


REC_COLS = ["site_id", "candidate_id", "found", "meets_reliability", "message", "solar_mw", "wind_mw", "bess_power_mw",
            "bess_duration_h", "gas_mw", "firmness_pct", "total_annual_cost_usd", "lcoe_usd_per_mwh", "co2_tons"]


@register("recommended", with_sql(_RANK_SQL + ",\n" + SQ.recommended_sql(TARGET_PCT),
                                  f"SELECT {', '.join(REC_COLS)} FROM rec"))
def q_recommended(spark, sf_dir):
    """T2 + F8: the recommended configuration per site with its rationale."""
    r = SW.score_and_rank(_sweep(spark, sf_dir), TARGET_PCT)
    return SW.recommend(r, TARGET_PCT).select(*REC_COLS)


@register("screening", with_sql(_RANK_SQL + ",\n" + SQ.recommended_sql(TARGET_PCT), """
SELECT r.site_id, s.n_tested, s.n_reliable, s.n_pareto, r.candidate_id AS recommended_candidate_id,
  r.total_annual_cost_usd, r.firmness_pct, r.message
FROM rec r JOIN (SELECT site_id, count(*) AS n_tested, CAST(count_if(meets_reliability) AS BIGINT) AS n_reliable,
  CAST(count_if(is_pareto) AS BIGINT) AS n_pareto FROM ranked GROUP BY site_id) s ON s.site_id = r.site_id"""))
def q_screening(spark, sf_dir):
    """Sweep -> rank -> recommend, one summary row per site."""
    r = SW.score_and_rank(_sweep(spark, sf_dir), TARGET_PCT)
    counts = r.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_tested"),
                                      F.count_if("meets_reliability").alias("n_reliable"),
                                      F.count_if("is_pareto").alias("n_pareto"))
    rec = SW.recommend(r, TARGET_PCT)
    return rec.join(counts, "site_id").select("site_id", "n_tested", "n_reliable", "n_pareto",
                                              F.col("candidate_id").alias("recommended_candidate_id"),
                                              "total_annual_cost_usd", "firmness_pct", "message")


DRILL_COLS = ["site_id", "candidate_id", "ts", "solar_mw", "charge", "discharge", "soc", "gas_gen", "serve", "unserved",
              "clipped"]


@register("drilldown", with_sql(_RANK_SQL + ",\n" + SQ.recommended_sql(TARGET_PCT), f"""
SELECT {', '.join('d.' + c for c in DRILL_COLS)} FROM disp d
WHERE (d.site_id, d.candidate_id) IN (SELECT site_id, candidate_id FROM rec)"""))
def q_drilldown(spark, sf_dir):
    """The dispatch rows of each site's recommended candidate (semi join)."""
    chunks = SW.chunks_of(intervals(spark, sf_dir), SWEEP_BASE)
    rec = SW.recommend(SW.score_and_rank(SW.capacity_sweep(chunks, SWEEP_BASE, SWEEP_RANGES), TARGET_PCT), TARGET_PCT)
    return SW.drilldown(chunks, rec, SWEEP_BASE).select(*DRILL_COLS)


# ---------------------------------------------------------------------------
# D8 gas sizing, D9 slack trade-off, D12 batch grid
# ---------------------------------------------------------------------------
GAS_BASE = dict(SITE_CFG, gas_var_cost_usd_per_mwh=50.0)
GAS_CAPS = [0.0, 25.0, 50.0, 75.0, 100.0]
GAS_TARGET = 75.0
GSZ_COLS = ["site_id", "gas_capacity_mw", "firmness_pct", "merchant_revenue_cost_usd", "total_served_mwh",
            "total_gen_mwh", "total_clip_mwh", "natgas_total_cost_usd", "natgas_generation_mwh", "meets_target",
            "slope", "is_knee", "is_recommended"]


@register("gas_sizing", with_sql(SQ.gas_sizing_sql(GAS_BASE, GAS_CAPS, GAS_TARGET), f"SELECT {', '.join(GSZ_COLS)} FROM gsz"))
def q_gas_sizing(spark, sf_dir):
    """D8 + T3 + W8 + T4: gas capacities 0..100 MW per site, smallest meeting 75 %, knee of merchant value."""
    sw = SW.gas_capacity_sweep(intervals(spark, sf_dir), GAS_BASE, GAS_CAPS, GAS_TARGET)
    return SW.recommend_gas_capacity(sw, GAS_TARGET).select(*GSZ_COLS)


SLK_COLS = ["site_id", "slack_idx", "slack_pct", "served_floor_mwh", "candidate_id", "firmness_pct",
            "total_served_mwh", "merchant_revenue_usd", "slope", "is_knee"]


@register("slack_tradeoff", with_sql(_SWEEP_SQL + ",\n" + SQ.slack_sql(SW.DEFAULT_SLACKS),
                                     f"SELECT {', '.join(SLK_COLS)} FROM slk"))
def q_slack_tradeoff(spark, sf_dir):
    """D9 + J7: per slack, the best merchant value among sweep rows serving >= (1 - slack) x best; knee."""
    return SW.slack_tradeoff(_sweep(spark, sf_dir)).select(*SLK_COLS)


BATCH_BASE = dict(SITE_CFG, gas_enabled=False, gas_dispatchable=False, poi_limit_mw=250.0, battery_duration_h=4.0)
BATCH_LOADS, BATCH_POWERS, BATCH_STACKS = [100.0, 140.0], [0.0, 100.0, 200.0], [1, 2]
BAT_COLS = ["site_id", "load_level_mw", "power_mw", "stacks", "firmness_pct", "merchant_revenue_usd",
            "total_served_mwh", "grid_imp_mwh", "grid_exp_mwh", "total_charge_mwh", "total_natgas_mwh", "infeasible"]


@register("batch_grid", with_sql(SQ.batch_sql(BATCH_BASE, BATCH_LOADS, BATCH_POWERS, BATCH_STACKS),
                                 f"SELECT {', '.join(BAT_COLS)} FROM bat"))
def q_batch_grid(spark, sf_dir):
    """Load 100/140 x power 0/100/200 x stacks 1/2 per site, grid on, power x stacks."""
    return SW.batch_grid(intervals(spark, sf_dir), BATCH_BASE, BATCH_LOADS, BATCH_POWERS, BATCH_STACKS).select(*BAT_COLS)


# ---------------------------------------------------------------------------
# Phase 7: scenario bundles, text summary, preview
# ---------------------------------------------------------------------------
from wattline.sources import scenarios as SC  # noqa: E402
from wattline.sources.sinks import preview  # noqa: E402
from wattline.session import checkpoint_dir  # noqa: E402

SWEEP_SCENARIO = {"name": "Fixture sweep", "description": "Solar as multiples of each site's reference MW.",
                  "run_config": SWEEP_BASE, "econ": None, "screening_ranges": SWEEP_RANGES,
                  "reliability_target_pct": TARGET_PCT, "grid_allowed": False}
BUNDLES = [SC.COMMERCIAL, SWEEP_SCENARIO]


def _scenario_values_sql() -> str:
    rows = []
    for b in BUNDLES:
        bd = SC.bundle_dict(b)
        for n in SW.RANGE_NAMES:
            r = bd["screening_ranges"][n]
            ref = d(r["reference_mw"]) if r["reference_mw"] is not None else "CAST(NULL AS DOUBLE)"
            rows.append(f"('{bd['name']}', '{n}', '{r['mode']}', {SQ.list_sql(r['values'])}, {ref}, "
                        f"{d(bd['reliability_target_pct'])})")
    return "scn(scenario, resource, mode, vals, reference_mw, reliability_target_pct) AS (VALUES " + ", ".join(rows) + ")"


@register("scenario_table", with_sql(_REF_SQL + ",\n" + _scenario_values_sql() + f""",
res AS (SELECT s.scenario, r.site_id, s.resource, s.mode, s.reliability_target_pct,
  CASE WHEN s.mode = 'multipliers' THEN
    (CASE WHEN coalesce(s.reference_mw, CASE s.resource WHEN 'solar' THEN r.ref_solar_mw WHEN 'wind' THEN r.ref_wind_mw END) > 0
     THEN list_transform(s.vals, lambda v: v * coalesce(s.reference_mw, CASE s.resource WHEN 'solar' THEN r.ref_solar_mw
       WHEN 'wind' THEN r.ref_wind_mw END)) ELSE CAST([0.0] AS DOUBLE[]) END)
  ELSE s.vals END AS v FROM scn s, ref r)""", """
SELECT scenario, site_id, resource, mode, CAST(len(v) AS INTEGER) AS n_values, list_min(v) AS min_mw,
  list_max(v) AS max_mw, reliability_target_pct FROM res"""))
def q_scenario_table(spark, sf_dir):
    """S3 + S2 + F14 + F12: bundles written as JSON, read back, flattened and resolved per site."""
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/wattline-scenarios-{uuid.uuid4().hex}"
    SC.write_scenarios(SC.scenarios_df(spark, BUNDLES), path)
    flat = SC.ranges_flat(SC.read_scenarios(spark, path, multi_line=False).select(
        "name", "screening_ranges", "reliability_target_pct"))
    refs = SW.reference_mw(intervals(spark, sf_dir))
    # a row per site, resource and reference; scenarios meet the sites by resource
    site = refs.select("site_id", F.inline(F.array(*[F.struct(
        F.lit(n).alias("resource"), (F.col(f"ref_{n}_mw") if n in ("solar", "wind") else F.lit(None).cast("double")).alias("site_ref"))
        for n in SW.RANGE_NAMES])))
    rng = F.struct(F.col("resource").alias("name"), "mode", "values", "reference_mw")
    v = SW.resolve(rng, F.col("site_ref"))
    return site.join(flat, "resource").select(
        "scenario", "site_id", "resource", "mode", F.size(v).alias("n_values"), F.array_min(v).alias("min_mw"),
        F.array_max(v).alias("max_mw"), "reliability_target_pct")


SUMMARY = [("candidates", "n_tested", 0), ("solar MW", "solar_mw", 1), ("wind MW", "wind_mw", 1),
           ("battery MW", "bess_power_mw", 1), ("battery MWh", "bess_energy_mwh", 1), ("gas MW", "gas_mw", 1),
           ("load served %", "firmness_pct", 2), ("cost $/yr", "total_annual_cost_usd", 2), ("CO2 t", "co2_tons", 3)]


def _summary_expr(name: str, target: float) -> F.Column:
    """The recommendation as lines of name and value, from the result columns."""
    value = lambda c, n: F.format_string(f"%.{n}f", F.round(F.col(c).cast("decimal(38,6)"), n).cast("double"))
    return F.concat_ws("\n", F.lit(f"{name}, target {target:.1f} %"), F.col("message"),
                       *[F.concat(F.lit(f"{label}: "), value(c, n)) for label, c, n in SUMMARY])


def _summary_sql() -> str:
    parts = [f"'{SWEEP_SCENARIO['name']}, target {TARGET_PCT:.1f} %'", "message"] + [
        f"'{label}: ' || printf('%.{n}f', {dr(f'CAST({c} AS DOUBLE)', n)})" for label, c, n in SUMMARY]
    return "SELECT site_id, concat_ws(chr(10), " + ", ".join(parts) + """) AS summary
FROM rec JOIN (SELECT site_id AS s_, count(*) AS n_tested FROM ranked GROUP BY site_id) t ON t.s_ = rec.site_id"""


@register("summary_lines", with_sql(_RANK_SQL + ",\n" + SQ.recommended_sql(TARGET_PCT), _summary_sql()))
def q_summary_lines(spark, sf_dir):
    """S9 + F8: the one-page text summary of each site's recommendation."""
    r = SW.score_and_rank(_sweep(spark, sf_dir), TARGET_PCT)
    n = r.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_tested"))
    rec = SW.recommend(r, TARGET_PCT).join(n, "site_id")
    return rec.select("site_id", _summary_expr(SWEEP_SCENARIO["name"], TARGET_PCT).alias("summary"))


@register("preview", with_sql("", f"SELECT {IV_COLS} FROM intervals ORDER BY site_id, ts LIMIT 20"))
def q_preview(spark, sf_dir):
    """The first 20 interval rows in (site, time) order."""
    return preview(intervals(spark, sf_dir), ["site_id", "ts"], 20)

from wattline.plans import catalog_more as _more  # noqa: E402,F401
