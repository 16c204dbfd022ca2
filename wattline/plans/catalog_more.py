"""Further registered queries: long keys and gaps, dirty input, grid-on sweeps,
scenario tables, and the branches that the main catalogue leaves out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.config import split_valid, with_config
from wattline.functions.clean import (OPTIONAL, REQUIRED, clean_intervals, interval_quality, month_days, month_label,
                                      tidy_columns, with_gas_availability, year_span)
from wattline.functions.profiles import fill_synthetic_load
from wattline.functions.text import parse_values
from wattline.operators.audit import commitment_columns, dispatch_audit, gas_commitment
from wattline.operators.balance import bounded_balance
from wattline.operators.dispatch import interval_position, scheduled_dispatch, serve_first_dispatch
from wattline.operators.metrics import monthly_cycles, monthly_cycles_map
from wattline.plans import catalog as C
from wattline.plans import sweep as SW
from wattline.plans import sweep_sql as SQ
from wattline.plans.catalog import SITE_CFG, d, intervals, register, with_sql
from wattline.plans.dispatch_sql import serve_first_sql
from wattline.session import checkpoint_dir, prepare_session
from wattline.sources import scenarios as SC
from wattline.sources.intervals import CSV_HEADERS, intervals_from_events, read_interval_csv
from wattline.sources.schedule import default_schedule_wide, read_schedule_csv, schedule_long, schedule_wide
from wattline.sources.sinks import write_records, write_table

Z = d(0.0)

# ---------------------------------------------------------------------------
# long keys and missing intervals
# ---------------------------------------------------------------------------
GROUPS = 16
_LONG_SQL = f"""
lg AS (SELECT site_id % {GROUPS} AS grp, ts + to_days(CAST(31 * (site_id // {GROUPS}) AS INTEGER)) AS ts,
         wind_mw + solar_mw + natgas_mw - load_mw AS a FROM intervals),
x AS (SELECT grp, list(a ORDER BY ts) AS al, list(ts ORDER BY ts) AS tl FROM lg GROUP BY grp),
r AS (SELECT grp, 1 AS n, {Z} AS soc0, least({d(C.BALANCE_CAP)}, greatest({Z}, {Z} + al[1])) AS soc FROM x
      UNION ALL
      SELECT x.grp, r.n + 1, r.soc, least({d(C.BALANCE_CAP)}, greatest({Z}, r.soc + x.al[r.n + 1]))
      FROM r JOIN x ON x.grp = r.grp WHERE r.n < len(x.al))"""


def _long_keys(spark, sf_dir) -> DataFrame:
    """Sites put end to end, 31 days each, so that keys run over several chunks."""
    iv = intervals(spark, sf_dir)
    return iv.withColumns({"grp": F.col("site_id") % GROUPS, "ts": F.expr(
        f"ts + make_dt_interval(CAST(31 * (site_id div {GROUPS}) AS INT))").cast("timestamp_ntz")})


@register("bounded_balance_long", with_sql(_LONG_SQL, """
SELECT r.grp, x.tl[r.n] AS ts, round(r.soc0, 6) AS soc_prev, round(r.soc, 6) AS soc FROM r JOIN x ON x.grp = r.grp"""))
def q_bounded_balance_long(spark, sf_dir):
    """W9 over keys of several time chunks."""
    iv = _long_keys(spark, sf_dir).withColumns({
        "step": F.col("wind_mw") + F.col("solar_mw") + F.col("natgas_mw") - F.col("load_mw"), "dt_hours": F.lit(1.0)})
    out = bounded_balance(iv.select("grp", "ts", "step", interval_position().alias("_pos")), ["grp"], "_pos", "step", 0.0,
                          C.BALANCE_CAP, order=["ts"])
    return out.select("grp", "ts", F.round("soc_prev", 6).alias("soc_prev"), F.round("soc", 6).alias("soc"))


def _gaps(iv: DataFrame) -> DataFrame:
    return iv.where(~F.hour("ts").isin(3, 4, 17))


_GAP_SQL = "iv_gaps AS (SELECT * FROM intervals WHERE hour(ts) NOT IN (3, 4, 17)),\n"


@register("gas_starts_gaps", with_sql(_GAP_SQL + serve_first_sql(C.AUDIT_CFG, src="iv_gaps"), C._GS_SQL))
def q_gas_starts_gaps(spark, sf_dir):
    """W2-W5 on series with three hours a day missing: windows count rows."""
    disp = serve_first_dispatch(_gaps(intervals(spark, sf_dir)), keys=["site_id"], cfg=C.AUDIT_CFG)
    return gas_commitment(commitment_columns(disp, ["site_id"]), keys=["site_id"]).select(*C.GS_COLS)


@register("dispatch_audit_gaps", with_sql(_GAP_SQL + serve_first_sql(C.AUDIT_CFG, src="iv_gaps") + ",\n" + C._au_body, C._au_sel))
def q_dispatch_audit_gaps(spark, sf_dir):
    """D7 on series with three hours a day missing."""
    disp = serve_first_dispatch(_gaps(intervals(spark, sf_dir)), keys=["site_id"], cfg=C.AUDIT_CFG)
    return dispatch_audit(disp, keys=["site_id"])


# ---------------------------------------------------------------------------
# dirty input
# ---------------------------------------------------------------------------

def _dirty(spark, sf_dir) -> DataFrame:
    """The intervals as text with bad cells by site and hour, and without the gas column."""
    iv = intervals_from_events(spark, sf_dir)
    k = F.col("site_id") * 31 + F.hour("ts") * 7 + F.dayofmonth("ts")
    text = lambda c: F.col(c).cast("string")
    return iv.select(
        "site_id", F.when(k % 19 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.when(k % 11 == 0, F.concat(F.lit("-"), text("wind_mw"))).otherwise(text("wind_mw")).alias("wind_mw"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(text("solar_mw")).alias("solar_mw"),
        F.when(k % 5 == 0, F.lit("n/a")).otherwise(text("load_mw")).alias("load_mw"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(text("price")).alias("price"))


_DIRTY_SQL = """
dk AS (SELECT *, site_id * 31 + hour(ts) * 7 + day(ts) AS k FROM intervals),
dirty AS (SELECT site_id, CASE WHEN k % 19 != 0 THEN ts END AS ts, CASE WHEN k % 11 = 0 THEN -wind_mw ELSE wind_mw END AS wind_mw,
  CASE WHEN k % 7 != 0 THEN solar_mw END AS solar_mw, CAST(NULL AS DOUBLE) AS natgas_mw,
  CASE WHEN k % 5 != 0 THEN load_mw END AS load_mw, CASE WHEN k % 13 != 0 THEN price END AS price FROM dk)"""


@register("intervals_dirty_clean", with_sql(_DIRTY_SQL, f"""
SELECT site_id, ts, greatest({Z}, wind_mw) AS wind_mw, coalesce(solar_mw, {Z}) AS solar_mw, {Z} AS natgas_mw,
  coalesce(load_mw, {Z}) AS load_mw, coalesce(price, {Z}) AS price FROM dirty WHERE ts IS NOT NULL"""))
def q_intervals_dirty_clean(spark, sf_dir):
    """Text, nulls, negatives, bad times and a missing column."""
    prepare_session(spark)
    return clean_intervals(_dirty(spark, sf_dir))


@register("quality_dirty", with_sql(_DIRTY_SQL, C._Q_SQL.replace("FROM intervals", "FROM dirty")))
def q_quality_dirty(spark, sf_dir):
    """P4, P6, P7, P9-P11, A25 on the dirty table."""
    prepare_session(spark)
    return interval_quality(_dirty(spark, sf_dir))


@register("sources_off", with_sql("", f"""
SELECT site_id, ts, {Z} AS wind_mw, solar_mw, {Z} AS natgas_mw, load_mw, price FROM intervals"""))
def q_sources_off(spark, sf_dir):
    """Wind and gas switched off."""
    prepare_session(spark)
    return clean_intervals(intervals_from_events(spark, sf_dir), {"wind_mw": False, "natgas_mw": False, "solar_mw": True})


LOAD_CFG = dict(SITE_CFG, load_type="16-7", base_load_mw=35.0)


@register("load_filled", with_sql("", f"""
SELECT site_id, ts, CASE WHEN site_id % 3 = 0 THEN CASE WHEN hour(ts) BETWEEN 7 AND 22 THEN {d(35.0)} ELSE {Z} END
  ELSE load_mw END AS load_mw FROM intervals"""))
def q_load_filled(spark, sf_dir):
    """Sites whose load is zero throughout get the synthetic one."""
    iv = intervals(spark, sf_dir).withColumn("load_mw", F.when(F.col("site_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("load_mw")))
    return fill_synthetic_load(with_config(iv, LOAD_CFG)).select("site_id", "ts", "load_mw")


@register("gas_availability", with_sql("", """
SELECT site_id, ts, CASE WHEN hour(ts) % 2 = 0 THEN natgas_mw * 2 ELSE natgas_mw END AS gas_avail_mw FROM intervals"""))
def q_gas_availability(spark, sf_dir):
    """An availability column with holes falls back to the gas column."""
    iv = intervals(spark, sf_dir).withColumn("gas_avail_mw", F.when(F.hour("ts") % 2 == 0, F.col("natgas_mw") * 2))
    return with_gas_availability(iv).select("site_id", "ts", "gas_avail_mw")


@register("tidy", with_sql("", "SELECT site_id, ts, wind_mw, price FROM intervals"))
def q_tidy(spark, sf_dir):
    """P20: empty and unnamed columns go, text becomes numbers."""
    iv = intervals(spark, sf_dir)
    return tidy_columns(iv.select("site_id", "ts", F.col("wind_mw").cast("string").alias("wind_mw"),
                                  F.lit(None).cast("string").alias("solar_mw"), F.lit(1).alias("Unnamed: 3"), "price"))


@register("values_parsed", with_sql("", f"""
SELECT site_id, ts, CAST(3 AS BIGINT) AS n, wind_mw + solar_mw + {d(7.5)} AS total FROM intervals"""))
def q_values_parsed(spark, sf_dir):
    """value lists from text with mixed separators and bad items."""
    iv = intervals(spark, sf_dir)
    v = parse_values(F.concat(F.col("wind_mw").cast("string"), F.lit(";x, "), F.col("solar_mw").cast("string"), F.lit(" 7.5")), [0.0])
    return iv.select("site_id", "ts", F.size(v).cast("long").alias("n"),
                     F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("config_quarantine", C._grid_sql_select("""
SELECT site_id, candidate_id, concat_ws('; ', CASE WHEN candidate_id % 5 = 0 THEN 'rte must be in (0, 1)' END,
  CASE WHEN candidate_id % 7 = 0 THEN 'unknown load_type' END, CASE WHEN candidate_id % 9 = 0 THEN 'unknown gas_cost_mode' END,
  CASE WHEN candidate_id % 11 = 0 THEN 'dt_hours must be positive' END) AS problems,
  NOT (candidate_id % 5 = 0 OR candidate_id % 7 = 0 OR candidate_id % 9 = 0 OR candidate_id % 11 = 0) AS is_valid FROM cand"""))
def q_config_quarantine(spark, sf_dir):
    """Valid and invalid candidate configurations, with their problems."""
    c = F.col("candidate_id")
    bad = C._cand_cfg(spark, sf_dir, C.SWEEP_BASE).withColumns({
        "rte": F.when(c % 5 == 0, F.lit(1.2)).otherwise(F.col("rte")),
        "load_type": F.when(c % 7 == 0, F.lit("sometimes")).otherwise(F.col("load_type")),
        "gas_cost_mode": F.when(c % 9 == 0, F.lit("free")).otherwise(F.col("gas_cost_mode")),
        "dt_hours": F.when(c % 11 == 0, F.lit(0.0)).otherwise(F.col("dt_hours"))})
    good, quarantine = split_valid(bad)
    return good.select("site_id", "candidate_id", F.lit("").alias("problems"), F.lit(True).alias("is_valid")).unionByName(
        quarantine.select("site_id", "candidate_id", F.array_join("problems", "; ").alias("problems"),
                          F.lit(False).alias("is_valid")))


# ---------------------------------------------------------------------------
# further branches of the dispatch
# ---------------------------------------------------------------------------

@register("price_per_kwh", C._disp_sql(["site_id", "ts", "price_per_kwh", "net_to_grid", "unserved"], grid_on=True))
def q_price_per_kwh(spark, sf_dir):
    """P17 (and the net exchange) of the grid-on dispatch."""
    return C._sf(spark, sf_dir, grid_on=True).select("site_id", "ts", "price_per_kwh", "net_to_grid", "unserved")


@register("dispatch_gas_storage", with_sql(serve_first_sql(C.SITE_CFG, gas_charges_storage=True),
                                           f"SELECT {', '.join(C.DISP_COLS)} FROM disp"))
def q_dispatch_gas_storage(spark, sf_dir):
    """D2 with spare gas capacity charging the battery."""
    return C._sf(spark, sf_dir, gas_charges_storage=True).select(*C.DISP_COLS)


@register("scheduled_gridon", with_sql(C.d1_sql(SITE_CFG, grid_on=True), """
SELECT site_id, ts, act AS schedule_action, charge1 AS charge, discharge1 AS discharge, soc, serve, grid_exp, grid_imp,
  clipped FROM disp"""))
def q_scheduled_gridon(spark, sf_dir):
    """D1 with the grid: charging and import up to the connection."""
    out = scheduled_dispatch(intervals(spark, sf_dir), schedule_long(default_schedule_wide(spark)), keys=["site_id"],
                             cfg=SITE_CFG, grid_on=True)
    return out.select("site_id", "ts", "schedule_action", "charge", "discharge", "soc", "serve", "grid_exp", "grid_imp", "clipped")


@register("cycles_map", C.REGISTRY["monthly_cycles"][1].replace("SELECT site_id, month,", "SELECT site_id, count(*) AS n_months, max(cycles) AS most FROM (SELECT site_id, month,") + ") GROUP BY site_id")
def q_cycles_map(spark, sf_dir):
    """Cycles per month as one map per site; its size and largest value."""
    m = monthly_cycles_map(monthly_cycles(C._d1(spark, sf_dir), keys=["site_id"]), keys=["site_id"])
    return m.select("site_id", F.size("cycles_per_month").cast("long").alias("n_months"),
                    F.array_max(F.map_values("cycles_per_month")).alias("most"))


# ---------------------------------------------------------------------------
# grid-on sweeps and failed candidates
# ---------------------------------------------------------------------------
GRID_BASE = dict(C.SWEEP_BASE, poi_limit_mw=110.0, gas_var_cost_usd_per_mwh=40.0)
GRID_RANGES = {"solar": dict(mode="multipliers", values=[0.5, 1.5], reference_mw=None),
               "wind": dict(mode="pinned", values=[0.0], reference_mw=None),
               "bess_power": dict(mode="absolute", values=[10.0, 40.0], reference_mw=None),
               "bess_duration": dict(mode="absolute", values=[2.0], reference_mw=None),
               "gas": dict(mode="absolute", values=[0.0, 25.0, 60.0], reference_mw=None)}
_GRID_SQL = SQ.sweep_sql(GRID_BASE, GRID_RANGES, grid_on=True)
_GRID_RANKED = _GRID_SQL + ",\n" + SQ.ranked_sql(99.0)


def _grid_sweep(spark, sf_dir) -> DataFrame:
    return SW.capacity_sweep(intervals(spark, sf_dir), GRID_BASE, GRID_RANGES, grid_allowed=True)


@register("capacity_sweep_gridon", with_sql(_GRID_SQL, "SELECT * FROM sweep"))
def q_capacity_sweep_gridon(spark, sf_dir):
    """D10 with the grid: candidates whose import exceeds the connection are not ok."""
    return _grid_sweep(spark, sf_dir)


@register("recommended_gridon", with_sql(_GRID_RANKED + ",\n" + SQ.recommended_sql(99.0), """
SELECT s.site_id, coalesce(r.found, false) AS found, r.candidate_id, r.total_annual_cost_usd,
  coalesce(r.message, 'no candidate') AS message, s.n_ok
FROM (SELECT site_id, CAST(count_if(ok) AS BIGINT) AS n_ok FROM sweep GROUP BY site_id) s LEFT JOIN rec r ON r.site_id = s.site_id"""))
def q_recommended_gridon(spark, sf_dir):
    """Failed candidates are never recommended; a site without another has none."""
    r = SW.score_and_rank(_grid_sweep(spark, sf_dir), 99.0)
    sites = r.groupBy("site_id").agg(F.count_if("ok").alias("n_ok"))
    return SW.recommend(r, 99.0, sites).join(sites, "site_id").select(
        "site_id", "found", "candidate_id", "total_annual_cost_usd", "message", "n_ok")


@register("sweep_over_cap", with_sql(C._REF_SQL, """
SELECT site_id, false AS ok, 'grid of 54 candidates is over the limit of 50' AS error FROM ref
WHERE ref_solar_mw > 0 UNION ALL SELECT site_id, true, '' FROM ref WHERE ref_solar_mw <= 0"""))
def q_sweep_over_cap(spark, sf_dir):
    """With a limit of 50 candidates a site's grid of 54 gives one failed row."""
    sw = SW.capacity_sweep(intervals(spark, sf_dir), C.SWEEP_BASE, C.SWEEP_RANGES, cap=50)
    return sw.select("site_id", "ok", "error").distinct()


_AUDIT_WIN = C._audit_sql(dict(C.SWEEP_BASE))
_WIN_SQL = _AUDIT_WIN[0].replace(f"{d(C.SWEEP_BASE['battery_power_mw'] * C.SWEEP_BASE['battery_duration_h'])}", "e1").replace(
    "FROM disp WINDOW", "FROM windisp WINDOW").replace("count_if(false AND ((gas_gen", "count_if(gas_disp AND ((gas_gen")


@register("winner_audit", with_sql(C._RANK_SQL + ",\n" + SQ.recommended_sql(C.TARGET_PCT) + """,
windisp AS (SELECT d.* FROM disp d JOIN rec r ON r.site_id = d.site_id AND r.candidate_id = d.candidate_id),
""" + _WIN_SQL, _AUDIT_WIN[1]))
def q_winner_audit(spark, sf_dir):
    """D7 + J6: the recommended candidate's dispatch holds to every rule."""
    chunks = SW.chunks_of(intervals(spark, sf_dir), C.SWEEP_BASE)
    sweep = SW.capacity_sweep(chunks, C.SWEEP_BASE, C.SWEEP_RANGES)
    rec = SW.recommend(SW.score_and_rank(sweep, C.TARGET_PCT), C.TARGET_PCT)
    disp = SW.drilldown(chunks, rec, C.SWEEP_BASE)
    return dispatch_audit(disp, keys=["site_id", "candidate_id"]).drop("candidate_id")


@register("gas_sizing_gridon", with_sql(SQ.gas_sizing_sql(C.GAS_BASE, C.GAS_CAPS, C.GAS_TARGET, grid_on=True),
                                        f"SELECT {', '.join(C.GSZ_COLS)} FROM gsz"))
def q_gas_sizing_gridon(spark, sf_dir):
    """D8 with the grid."""
    sw = SW.gas_capacity_sweep(intervals(spark, sf_dir), C.GAS_BASE, C.GAS_CAPS, C.GAS_TARGET, grid_allowed=True)
    return SW.recommend_gas_capacity(sw, C.GAS_TARGET).select(*C.GSZ_COLS)


# ---------------------------------------------------------------------------
# sweeps driven by a table of scenarios
# ---------------------------------------------------------------------------
_SMALL = {"solar": dict(mode="multipliers", values=[0.5, 1.0], reference_mw=None),
          "wind": dict(mode="absolute", values=[0.0, 30.0], reference_mw=None),
          "bess_power": dict(mode="absolute", values=[10.0], reference_mw=None),
          "bess_duration": dict(mode="absolute", values=[2.0, 4.0], reference_mw=None),
          "gas": dict(mode="absolute", values=[0.0, 20.0], reference_mw=None)}
#: Sites whose load column is empty, so that their scenario's synthetic load is used.
_IDLE = 6
SITE_SCENARIOS = [
    {"name": "island", "run_config": dict(C.SWEEP_BASE, voll_usd_per_mwh=3000.0, start_date="2024-01-03", end_date="2024-01-20"),
     "econ": None, "screening_ranges": _SMALL,
     "reliability_target_pct": 70.0, "grid_allowed": False},
    {"name": "grid", "run_config": dict(C.SWEEP_BASE, poi_limit_mw=120.0, gas_var_cost_usd_per_mwh=35.0, start_date="2023-12-01",
                                        end_date="2024-01-25"),
     "econ": {"solar": (900.0, 0.0, 12.0, 25.0, 0.06), "carbon_price_usd_per_ton": 0.0},
     "screening_ranges": _SMALL, "reliability_target_pct": 95.0, "grid_allowed": True},
    {"name": "carbon", "run_config": dict(C.SWEEP_BASE, rte=0.9, load_type="24-7", base_load_mw=30.0, start_date="2024-01-10",
                                          end_date="2024-02-15"), "econ": {"carbon_price_usd_per_ton": 80.0},
     "screening_ranges": dict(_SMALL, gas=dict(mode="absolute", values=[10.0, 40.0], reference_mw=None)),
     "reliability_target_pct": 60.0, "grid_allowed": False},
]


def _scenario_sql(k: int, b: dict) -> str:
    econ = dict(b["econ"] or {})
    carbon = float(econ.pop("carbon_price_usd_per_ton", 0.0))
    base = dict(b["run_config"], carbon_price_usd_per_ton=max(carbon, float(b["run_config"].get("carbon_price_usd_per_ton", 0.0))))
    body = SQ.sweep_sql(base, b["screening_ranges"], econ or None, grid_on=b["grid_allowed"]).replace(
        "FROM intervals", "FROM iv_k")
    c = b["run_config"]
    load = f"CASE WHEN hour(ts) BETWEEN 7 AND 22 THEN {d(c['base_load_mw'])} ELSE {Z} END" if c["load_type"] == "16-7" else d(
        c["base_load_mw"])
    window = (f"iv_k AS (SELECT * EXCLUDE (load_mw), CASE WHEN site_id % {_IDLE} = 1 THEN {load} ELSE load_mw END AS load_mw "
              f"FROM intervals WHERE site_id % 3 = {k} AND ts >= TIMESTAMP '{c['start_date']}' "
              f"AND ts < TIMESTAMP '{c['end_date']}' + INTERVAL 1 DAY),\n")
    inner = with_sql(window + body + ",\n"
                     + SQ.ranked_sql(b["reliability_target_pct"]), f"""
SELECT site_id, '{b['name']}' AS scenario, count(*) AS n_tested, CAST(count_if(meets_reliability) AS BIGINT) AS n_reliable,
  CAST(count_if(is_pareto) AS BIGINT) AS n_pareto, max(CASE WHEN rank = 1 AND ok THEN candidate_id END) AS candidate_id,
  max(CASE WHEN rank = 1 AND ok THEN total_annual_cost_usd END) AS total_annual_cost_usd,
  max(CASE WHEN rank = 1 AND ok THEN firmness_pct END) AS firmness_pct FROM ranked GROUP BY site_id""")
    return f"SELECT * FROM ({inner})"


@register("screening_scenarios", "\nUNION ALL\n".join(_scenario_sql(k, b) for k, b in enumerate(SITE_SCENARIOS)))
def q_screening_scenarios(spark, sf_dir):
    """Sites screened by scenarios read from files, one scenario a site, in the scenario's window, with
    its synthetic load where the load column is empty."""
    iv = intervals(spark, sf_dir).withColumn("load_mw", F.when(F.col("site_id") % _IDLE == 1, 0.0).otherwise(F.col("load_mw")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/wattline-scenarios-{uuid.uuid4().hex}"
    SC.write_scenarios(SC.scenarios_df(spark, SITE_SCENARIOS), path)
    scenarios = SC.read_scenarios(spark, path, multi_line=False).withColumn(
        "sid", F.array_position(F.array(*[F.lit(b["name"]) for b in SITE_SCENARIOS]), F.col("name")) - 1)
    sites = iv.select("site_id").distinct().withColumn("sid", F.col("site_id") % 3).join(scenarios, "sid").drop("sid")
    r = SW.scenario_screening(iv, sites)
    best = F.when((F.col("rank") == 1) & F.col("ok"), F.struct("candidate_id", "total_annual_cost_usd", "firmness_pct"))
    return r.groupBy("site_id", "scenario").agg(
        F.count(F.lit(1)).alias("n_tested"), F.count_if("meets_reliability").alias("n_reliable"),
        F.count_if("is_pareto").alias("n_pareto"), F.max(best).alias("b")).select(
            "site_id", "scenario", "n_tested", "n_reliable", "n_pareto", "b.candidate_id", "b.total_annual_cost_usd",
            "b.firmness_pct")


# ---------------------------------------------------------------------------
# D5 + W5: minimum up and down times kept by the dispatch
# ---------------------------------------------------------------------------
COMMIT_CFG = dict(C.SITE_CFG, gas_min_up_h=4, gas_min_down_h=6)
_COMMIT_SQL = serve_first_sql(COMMIT_CFG, commitment=True)


def _committed(spark, sf_dir, **kw) -> DataFrame:
    return serve_first_dispatch(intervals(spark, sf_dir), keys=["site_id"], cfg=COMMIT_CFG, commitment=True, **kw)


@register("gas_committed", with_sql(_COMMIT_SQL, f"SELECT {', '.join(C.DISP_COLS)} FROM disp"))
def q_gas_committed(spark, sf_dir):
    """D5 + W5: dispatch whose gas unit keeps 4 h up and 6 h down, grid off."""
    return _committed(spark, sf_dir).select(*C.DISP_COLS)


@register("gas_committed_gridon", with_sql(serve_first_sql(COMMIT_CFG, commitment=True, grid_on=True, two_battery=True),
                                           f"SELECT {', '.join(C.TWO_COLS)} FROM disp"))
def q_gas_committed_gridon(spark, sf_dir):
    """D5 + W5 with the grid and two batteries: forced output is exported."""
    return _committed(spark, sf_dir, grid_on=True, two_battery=True).select(*C.TWO_COLS)


@register("gas_committed_ramp", with_sql(serve_first_sql(COMMIT_CFG, commitment=True, ramp=True),
                                         f"SELECT {', '.join(C.DISP_COLS)} FROM disp"))
def q_gas_committed_ramp(spark, sf_dir):
    """D5 + W5: minimum times over a ramp-limited output."""
    return _committed(spark, sf_dir, gas_follow_ramp=True).select(*C.DISP_COLS)


_COMMIT_AUDIT = C._audit_sql(COMMIT_CFG)


@register("commitment_audit", with_sql(_COMMIT_SQL + ",\n" + _COMMIT_AUDIT[0], _COMMIT_AUDIT[1]))
def q_commitment_audit(spark, sf_dir):
    """D7 over the committed dispatch: no violation of the minimum times."""
    return dispatch_audit(_committed(spark, sf_dir), keys=["site_id"])


# ---------------------------------------------------------------------------
# files written from the tables and read back (S1, S4, S6, S7), calendar
# ---------------------------------------------------------------------------

def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/wattline-{name}-{uuid.uuid4().hex}"


@register("intervals_csv", with_sql("", f"""
SELECT site_id, ts, CASE WHEN site_id % 2 = 0 THEN wind_mw ELSE {Z} END AS wind_mw, solar_mw, natgas_mw, load_mw, price,
  CASE WHEN site_id % 2 = 0 THEN 'site ' || site_id || ', "hour"' || chr(10) || hour(ts) END AS note FROM intervals"""))
def q_intervals_csv(spark, sf_dir):
    """CSV files with different headers, quoted commas, quotes and line breaks, read back by header."""
    h = dict(CSV_HEADERS)
    iv = intervals(spark, sf_dir).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    note = F.concat(F.lit("site "), F.col("site_id").cast("string"), F.lit(', "hour"\n'), F.hour("ts").cast("string"))
    path = _folder(spark, "csv")
    even = iv.where("site_id % 2 = 0").select(
        note.alias("Note"), F.col("price").alias(h["price"]), F.col("stamp").alias(h["ts"]), F.col("site_id").alias("Site"),
        *[F.col(c).alias(h[c]) for c in ("load_mw", "wind_mw", "natgas_mw", "solar_mw")])
    odd = iv.where("site_id % 2 = 1").select(
        F.col("stamp").alias(h["ts"]), *[F.col(c).alias(h[c]) for c in ("solar_mw", "natgas_mw", "load_mw", "price")],
        F.col("site_id").alias("Site"))
    for name, part in (("even", even), ("odd", odd)):
        part.write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
    raw = read_interval_csv(spark, path, site_id=F.col("site").cast("bigint"), headers=h | {"site": "Site", "note": "Note"},
                            range_bytes=1 << 16)
    clean = clean_intervals(raw)
    notes = raw.select("site_id", F.col("ts").try_cast("timestamp_ntz").alias("ts"), "note")
    return clean.join(notes, ["site_id", "ts"])


@register("schedule_csv", with_sql("", """
SELECT CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour,
  CASE WHEN count_if(solar_mw > load_mw) * 3 > count(*) THEN 'C' WHEN count_if(load_mw > wind_mw) * 3 > count(*) THEN 'D' ELSE '' END AS action
FROM intervals GROUP BY 1, 2"""))
def q_schedule_csv(spark, sf_dir):
    """A schedule by month and hour, written as a wide CSV template and read back."""
    iv = intervals(spark, sf_dir)
    often = lambda cond: F.count_if(cond) * 3 > F.count(F.lit(1))
    lng = iv.groupBy(F.month("ts").alias("month"), F.hour("ts").alias("hour")).agg(
        F.when(often(F.col("solar_mw") > F.col("load_mw")), " c").when(often(F.col("load_mw") > F.col("wind_mw")), "d ")
        .otherwise("").alias("action"))
    path = _folder(spark, "schedule")
    write_table(schedule_wide(lng).withColumnsRenamed({f"h{k}": str(k) for k in range(24)}), path, "csv")
    return schedule_long(read_schedule_csv(spark, path))


@register("tables_written", with_sql(C._REF_SQL, f"""
SELECT i.site_id, strftime(ts, '%Y-%m') AS month, count(*) AS n, max(load_mw) AS peak_mw, r.ref_solar_mw, r.ref_wind_mw
FROM intervals i JOIN ref r ON r.site_id = i.site_id GROUP BY ALL"""))
def q_tables_written(spark, sf_dir):
    """Intervals as Parquet partitioned by month and reference MW as CSV, written and read back."""
    iv = intervals(spark, sf_dir)
    rows, refs = _folder(spark, "intervals"), _folder(spark, "refs")
    write_table(iv.withColumn("month", month_label(F.col("ts"))), rows, partition_by=["month"])
    write_table(SW.reference_mw(iv), refs, "csv")
    back = spark.read.schema("site_id long, ts timestamp_ntz, load_mw double, month string").parquet(rows)
    ref = spark.read.option("header", True).schema("site_id long, ref_solar_mw double, ref_wind_mw double").csv(refs)
    return back.groupBy("site_id", "month").agg(F.count(F.lit(1)).alias("n"), F.max("load_mw").alias("peak_mw")).join(ref, "site_id")


@register("records_written", with_sql(C._REF_SQL, """
SELECT r.site_id, r.ref_solar_mw AS solar_mw, r.ref_wind_mw AS wind_mw, i.n, i.months
FROM ref r JOIN (SELECT site_id, count(*) AS n, string_agg(DISTINCT strftime(ts, '%Y-%m'), ',' ORDER BY strftime(ts, '%Y-%m')) AS months
                 FROM intervals GROUP BY site_id) i ON i.site_id = r.site_id"""))
def q_records_written(spark, sf_dir):
    """Nested records as JSON lines, written and read back."""
    iv = intervals(spark, sf_dir)
    rec = SW.reference_mw(iv).join(iv.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(month_label(F.col("ts")))).alias("months")), "site_id").select(
            "site_id", F.struct(F.col("ref_solar_mw").alias("solar_mw"), F.col("ref_wind_mw").alias("wind_mw")).alias("config"),
            F.struct("n", "months").alias("horizon"))
    path = _folder(spark, "records")
    write_records(rec, path)
    back = spark.read.schema(rec.schema).json(path)
    return back.select("site_id", "config.solar_mw", "config.wind_mw", "horizon.n", F.concat_ws(",", "horizon.months").alias("months"))


@register("calendar", with_sql("", """
SELECT site_id, strftime(ts, '%Y-%m') AS month, CAST(max(day(last_day(ts))) AS INTEGER) AS days_in_month,
  CASE WHEN min(year(ts)) = max(year(ts)) THEN CAST(min(year(ts)) AS VARCHAR)
       ELSE min(year(ts)) || '-' || max(year(ts)) END AS years, count(*) AS n
FROM (SELECT site_id, ts + to_days(CAST((site_id % 5) * 80 AS INTEGER)) AS ts FROM intervals
      UNION ALL SELECT site_id, ts + to_days(CAST((site_id % 3) * 120 AS INTEGER)) FROM intervals) GROUP BY ALL"""))
def q_calendar(spark, sf_dir):
    """month, days in it and span of years, over series moved by some months."""
    iv = intervals(spark, sf_dir).select("site_id", "ts")
    moved = lambda n, k: iv.withColumn("ts", F.col("ts") + F.make_dt_interval(F.col("site_id") % n * k))
    d = moved(5, 80).unionByName(moved(3, 120))
    return d.groupBy("site_id", month_label(F.col("ts")).alias("month")).agg(
        F.max(month_days(F.col("ts"))).alias("days_in_month"), year_span(F.min("ts"), F.max("ts")).alias("years"),
        F.count(F.lit(1)).alias("n"))
