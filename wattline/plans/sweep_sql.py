"""DuckDB statements of the capacity sweep, for the oracle.

The dispatch text mirrors ``operators.dispatch.serve_first_dispatch`` with
every parameter given as an SQL expression (a candidate column or a double
literal), so candidates with different sizes share one statement.  The
balance is a recursive CTE stepping through a per-key list of steps.
"""

from __future__ import annotations

from typing import Any, Mapping

from wattline.config import full_config
from wattline.functions.econ import DEFAULT_ECON, HOURS_PER_YEAR, RESOURCES
from wattline.plans.sweep import CAND_COLS, RANGE_NAMES


from wattline.plans.sqlfrag import asdbl, d, dr, iround, isum  # noqa: E402


def lit(v: Any) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return f"'{v}'"
    return d(v)


def params(base: Mapping[str, Any], varying: Mapping[str, str]) -> dict[str, str]:
    """SQL expression per configuration field: candidate expressions override literals."""
    full = full_config(base)
    out = {k: lit(v) for k, v in full.items() if k not in ("start_date", "end_date", "load_type")}
    out.update(varying)
    return out


def dispatch_sql(P: dict[str, str], src: str, keys: list[str], grid_on: bool = False) -> str:
    """CTE chain from ``src`` (interval rows per key) to ``disp`` (serve-first, grid off or on)."""
    k = ", ".join(keys)
    kj = " AND ".join(f"x.{c} = y.{c}" for c in keys)
    z = d(0.0)
    ng = f"greatest({z}, coalesce(natgas_mw, {z}))"
    pmax = f"(CASE WHEN {P['gas_pmax_mw']} > 0 THEN {P['gas_pmax_mw']} ELSE {z} END)"
    use = P["gas_use_profile_as_cap"]
    en, disp = P["gas_enabled"], P["gas_dispatchable"]
    cap = (f"(CASE WHEN ({pmax} > 0) AND (NOT {use}) THEN {pmax} WHEN {use} THEN "
           f"(CASE WHEN {pmax} > 0 THEN least({ng}, {pmax}) ELSE {ng} END) ELSE {pmax} END)")
    must = (f"(CASE WHEN {en} AND {disp} THEN {z} WHEN {en} THEN (CASE WHEN ({pmax} > 0) AND ng_zero THEN {pmax} "
            f"WHEN {pmax} > 0 THEN least({ng}, {pmax}) ELSE {ng} END) ELSE {ng} END)")
    var = (f"(CASE WHEN NOT {en} THEN {z} WHEN {P['gas_cost_mode']} = 'advanced' THEN "
           f"{P['gas_heat_rate_mmbtu_per_mwh']} * {P['gas_fuel_price_usd_per_mmbtu']} + {P['gas_vom_usd_per_mwh']} "
           f"ELSE {P['gas_var_cost_usd_per_mwh']} END)")
    co2r = f"(CASE WHEN {en} THEN {P['gas_heat_rate_mmbtu_per_mwh']} * {P['gas_co2_tons_per_mmbtu']} ELSE {z} END)"
    noload = f"(CASE WHEN {en} THEN {P['gas_no_load_cost_usd_per_h']} ELSE {z} END)"
    marginal = f"({var} + {P['carbon_price_usd_per_ton']} * {co2r})"
    eta, dt, p = P["rte"], P["dt_hours"], P["battery_power_mw"]
    e1 = f"({P['battery_power_mw']} * {P['battery_duration_h']})"
    step = f"CASE WHEN x >= 0 THEN {eta} * {dt} * least({p}, x) ELSE (-{dt}) * least({p}, -(x)) END"
    return f"""
zq AS (SELECT site_id, sum({ng}) <= 1e-9 AS ng_zero FROM {src} GROUP BY site_id),
p0 AS (SELECT i.*, z.ng_zero, coalesce(wind_mw, {z}) + coalesce(solar_mw, {z}) AS gen_ren, {cap} AS gas_cap,
         ({en} AND {disp}) AS gas_disp, row_number() OVER (PARTITION BY {', '.join('i.' + c for c in keys)} ORDER BY i.ts) AS n
       FROM {src} i JOIN zq z ON z.site_id = i.site_id),
p1 AS (SELECT *, greatest({z}, least(CASE WHEN {pmax} > 0 THEN {pmax} ELSE gas_cap END, gas_cap)) AS pmax_t FROM p0),
p2 AS (SELECT *, least(greatest({z}, {P['gas_pmin_mw']}), pmax_t) AS pmin_t, {must} AS must_run FROM p1),
q AS (SELECT *, gen_ren + must_run AS gen, gen_ren + must_run - load_mw AS x, {e1} AS e1,
        gas_disp AND ({marginal} < {P['voll_usd_per_mwh']}) AS gas_ok FROM p2),
qa AS (SELECT *, {step} AS a FROM q),
st AS (SELECT {k}, list(a ORDER BY n) AS al, first(e1) AS e FROM qa GROUP BY {k}),
rr AS (SELECT {k}, 1 AS n, {z} AS s0, least(e, greatest({z}, {z} + al[1])) AS s FROM st
       UNION ALL
       SELECT {', '.join('x.' + c for c in keys)}, x.n + 1, x.s, least(y.e, greatest({z}, x.s + y.al[x.n + 1]))
       FROM rr x JOIN st y ON {kj} WHERE x.n < len(y.al)),
q1 AS (SELECT qa.*, rr.s AS soc1, greatest(rr.s - rr.s0, {z}) / ({eta} * {dt}) AS charge1,
         greatest(-(rr.s - rr.s0), {z}) / {dt} AS discharge1
       FROM qa JOIN rr ON {' AND '.join(f'rr.{c} = qa.{c}' for c in keys)} AND rr.n = qa.n),
q3 AS (SELECT *, {z} AS soc2, {z} AS charge2, {z} AS discharge2, charge1 + {z} AS charge, discharge1 + {z} AS discharge
       FROM q1),
q4 AS (SELECT *, CASE WHEN gas_ok{(" AND " + marginal + " < price") if grid_on else ""} THEN greatest({z}, load_mw + charge - gen - discharge) ELSE {z} END AS need FROM q3),
q5 AS (SELECT *, CASE WHEN need > 1e-9 THEN greatest(pmin_t, least(pmax_t, need)) ELSE {z} END AS gas_d FROM q4),
q6 AS (SELECT *, gen + gas_d + discharge - charge AS supply FROM q5),
{_grid_sql(P, grid_on)},
q10 AS (SELECT *, must_run + gas_d AS gas_gen, gen_ren + must_run + gas_d AS generation, load_mw AS load,
        load_mw - serve AS unserved, soc1 + soc2 AS soc FROM q9),
q11 AS (SELECT *, CASE WHEN gas_gen > 1e-6 THEN {d(1.0)} ELSE {z} END AS gas_on FROM q10),
q12 AS (SELECT *, lag(gas_on) OVER (PARTITION BY {k} ORDER BY ts) AS on_prev FROM q11),
q13 AS (SELECT *, CASE WHEN gas_on > 0 AND coalesce(on_prev, {z}) <= 0 THEN {d(1.0)} ELSE {z} END AS gas_start,
        CASE WHEN gas_disp AND gas_on <= 0 AND coalesce(on_prev, {z}) > 0 THEN {d(1.0)} ELSE {z} END AS gas_stop FROM q12),
disp AS (SELECT *, gas_gen * {var} * {dt} + gas_start * {P['gas_startup_cost_usd']} + gas_on * {noload} * {dt} AS gas_cost,
         {var} AS p_var, {noload} AS p_noload, {co2r} AS p_co2r FROM q13)"""


def _grid_sql(P: dict[str, str], grid_on: bool) -> str:
    z = d(0.0)
    if not grid_on:
        return f"""q8 AS (SELECT *, least(load_mw, supply) AS serve, {z} AS grid_imp, {z} AS grid_exp, false AS infeasible FROM q6),
q9 AS (SELECT *, greatest({z}, supply - serve) AS clipped FROM q8)"""
    poi = P["poi_limit_mw"]
    return f"""q7 AS (SELECT *, greatest({z}, load_mw - supply) AS grid_imp, greatest({z}, supply - load_mw) AS surplus FROM q6),
q8 AS (SELECT *, least({poi}, surplus) AS grid_exp, load_mw AS serve, grid_imp > {poi} + 1e-9 AS infeasible FROM q7),
q9 AS (SELECT *, surplus - grid_exp AS clipped FROM q8)"""


def metrics_sql(P: dict[str, str], keys: list[str]) -> str:
    """CTE ``met`` over ``disp``: the run metrics used by the sweep (grid off)."""
    k = ", ".join(keys)
    dt = P["dt_hours"]

    def ds(x):
        return isum(x)
    z = d(0.0)
    g = f"""mg AS (SELECT {k}, count(*) AS n_, {ds(f'load * {dt}')} AS ld, {ds(f'serve * {dt}')} AS sv,
   {ds(f'unserved * {dt}')} AS us, {ds(f'(grid_exp - grid_imp) * price * {dt}')} AS mer, {ds('gas_cost')} AS gc,
   {ds(f'gas_gen * {dt}')} AS ng, {ds(f'discharge1 * {dt}')} AS d1, {ds(f'discharge2 * {dt}')} AS d2,
   {ds(f'generation * {dt}')} AS gn, {ds(f'clipped * {dt}')} AS cl, {ds(f'grid_imp * {dt}')} AS im,
   {ds(f'grid_exp * {dt}')} AS ex, {ds(f'charge * {dt}')} AS ch,
   sum(gas_start) AS st, sum(gas_on) AS onn, max(CAST(infeasible AS INTEGER)) AS inf,
   first(p_var) AS var, first(p_noload) AS noload, first(p_co2r) AS co2r
   FROM disp GROUP BY {k})"""
    natgas = asdbl("ng")
    starts = "CAST(round(st) AS BIGINT)"
    co2 = f"(co2r * {natgas})"
    parts = {
        "cost_unserved_usd": f"{P['voll_usd_per_mwh']} * {asdbl('us')}",
        "cost_gas_var_usd": f"var * {natgas}",
        "cost_gas_no_load_usd": f"noload * onn * {dt}",
        "cost_gas_startup_usd": f"{P['gas_startup_cost_usd']} * {starts}",
        "cost_bess_deg_usd": f"{P['bess_deg_cost_usd_per_mwh']} * ({asdbl('d1')} + {asdbl('d2')})",
        "cost_carbon_usd": f"{P['carbon_price_usd_per_ton']} * {co2}",
    }
    vals = list(parts.values())
    total = f"({vals[0]})"
    for v in vals[1:]:
        total = f"({total} + ({v}))"
    pct = f"CASE WHEN {asdbl('ld')} > 0 THEN {asdbl('sv')} / {asdbl('ld')} * 100 ELSE {z} END"
    return g + f""",
met AS (SELECT {k}, {dr(pct, 2)} AS firmness_pct, {iround('sv', 2)} AS total_served_mwh,
  {iround('us', 4)} AS unserved_energy_mwh, {iround('ng', 2)} AS total_natgas_mwh,
  {dr(co2, 3)} AS co2_tons, {iround('mer - gc', 2)} AS merchant_revenue_usd,
  {dr(total, 2)} AS total_operating_cost_usd, {', '.join(f'{dr(v, 2)} AS {n}' for n, v in parts.items())},
  {dr(f'n_ * {dt}', 4)} AS horizon_hours, inf > 0 AS infeasible,
  {iround('gn', 2)} AS total_gen_mwh, {iround('cl', 2)} AS total_clip_mwh, {iround('gc', 2)} AS natgas_total_cost_usd,
  {iround('im', 2)} AS grid_imp_mwh, {iround('ex', 2)} AS grid_exp_mwh, {iround('ch', 2)} AS total_charge_mwh FROM mg)"""


def list_sql(values) -> str:
    return "CAST([" + ", ".join(repr(float(v)) for v in values) + "] AS DOUBLE[])"


def resolved_sql(rng: Mapping[str, Any], site_ref: str | None) -> str:
    vals = list_sql(rng["values"])
    if rng["mode"] != "multipliers":
        return vals
    ref = d(rng["reference_mw"]) if rng.get("reference_mw") is not None else (site_ref or "NULL")
    return (f"(CASE WHEN {ref} > 0 THEN list_transform({vals}, lambda v: v * {ref}) "
            f"ELSE CAST([0.0] AS DOUBLE[]) END)")


def candidates_sql(ranges: Mapping[str, Mapping[str, Any]]) -> str:
    """CTEs ``ref`` (A24 per site) and ``cand`` (J1 grid, mixed-radix id)."""
    z = d(0.0)
    refs = {"solar": "ref_solar_mw", "wind": "ref_wind_mw"}
    lists = {c: resolved_sql(ranges[n], refs.get(n)) for n, c in zip(RANGE_NAMES, CAND_COLS)}
    parts = [f"""ref AS (SELECT site_id,
  coalesce(CAST(ceil(max(greatest(solar_mw, {z}))) AS DOUBLE), {z}) AS ref_solar_mw,
  coalesce(CAST(ceil(max(greatest(wind_mw, {z}))) AS DOUBLE), {z}) AS ref_wind_mw FROM intervals GROUP BY site_id)""",
             "g0 AS (SELECT site_id, ref_solar_mw, ref_wind_mw, "
             + ", ".join(f"{v} AS v_{c}" for c, v in lists.items()) + " FROM ref)"]
    prev = "g0"
    for i, c in enumerate(CAND_COLS):
        parts.append(f"c{i} AS (SELECT {prev}.*, unnest(v_{c}) AS {c}, generate_subscripts(v_{c}, 1) - 1 AS i_{c} FROM {prev})")
        prev = f"c{i}"
    cid = f"i_{CAND_COLS[0]}"
    for c in CAND_COLS[1:]:
        cid = f"({cid} * len(v_{c}) + i_{c})"
    parts.append(f"cand AS (SELECT site_id, CAST({cid} AS BIGINT) AS candidate_id, {', '.join(CAND_COLS)}, "
                 f"ref_solar_mw, ref_wind_mw FROM {prev})")
    return ",\n".join(parts)


def sweep_sql(base: Mapping[str, Any], ranges: Mapping[str, Mapping[str, Any]],
              econ: Mapping[str, Any] | None = None, grid_on: bool = False) -> str:
    """CTEs ending in ``sweep``: the 32-column sweep table per (site, candidate)."""
    pmin = float(base.get("gas_pmin_mw", 0.0) or 0.0)
    z = d(0.0)
    varying = {"battery_power_mw": "battery_power_mw", "battery_duration_h": "battery_duration_h",
               "gas_pmax_mw": "gas_pmax_mw", "gas_enabled": "gas_enabled", "gas_dispatchable": "gas_dispatchable",
               "gas_pmin_mw": "gas_pmin_mw"}
    P = params(base, varying)
    keys = ["site_id", "candidate_id"]
    fan = f"""fan AS (SELECT i.site_id, c.candidate_id, i.ts,
  CASE WHEN c.ref_wind_mw > 0 THEN i.wind_mw * (c.wind_mw / c.ref_wind_mw) ELSE {z} END AS wind_mw,
  CASE WHEN c.ref_solar_mw > 0 THEN i.solar_mw * (c.solar_mw / c.ref_solar_mw) ELSE {z} END AS solar_mw,
  i.natgas_mw, i.load_mw, i.price,
  c.bess_power_mw AS battery_power_mw, c.bess_duration_h AS battery_duration_h, c.gas_mw AS gas_pmax_mw,
  c.gas_mw > 0 AS gas_enabled, c.gas_mw > 0 AS gas_dispatchable, least({d(pmin)}, c.gas_mw) AS gas_pmin_mw
  FROM intervals i JOIN cand c ON c.site_id = i.site_id)"""
    e = {r: (econ or {}).get(r) or DEFAULT_ECON[r] for r in RESOURCES}

    def crf(r):
        rate, life = d(e[r][4]), d(e[r][3])
        return (f"(CASE WHEN {life} <= 0 THEN {z} WHEN abs({rate}) < 1e-9 THEN {d(1.0)} / {life} "
                f"ELSE {rate} / ({d(1.0)} - pow({d(1.0)} + {rate}, -{life})) END)")
    ann = {
        "annualized_solar_usd": f"{crf('solar')} * {d(e['solar'][0])} * solar_mw * 1000.0",
        "annualized_wind_usd": f"{crf('wind')} * {d(e['wind'][0])} * wind_mw * 1000.0",
        "annualized_bess_power_usd": f"{crf('bess')} * {d(e['bess'][0])} * bess_power_mw * 1000.0",
        "annualized_bess_energy_usd": f"{crf('bess')} * {d(e['bess'][1])} * bess_energy_mwh * 1000.0",
        "annualized_gas_usd": f"{crf('gas')} * {d(e['gas'][0])} * gas_mw * 1000.0",
    }
    fom = {
        "fixed_om_solar_usd_yr": f"{d(e['solar'][2])} * solar_mw * 1000.0",
        "fixed_om_wind_usd_yr": f"{d(e['wind'][2])} * wind_mw * 1000.0",
        "fixed_om_bess_usd_yr": f"{d(e['bess'][2])} * bess_power_mw * 1000.0",
        "fixed_om_gas_usd_yr": f"{d(e['gas'][2])} * gas_mw * 1000.0",
    }
    total = " + ".join(f"({v})" for v in list(ann.values()) + list(fom.values()))
    hy = d(HOURS_PER_YEAR)
    return ",\n".join([
        candidates_sql(ranges),
        fan,
        dispatch_sql(P, "fan", keys, grid_on).strip(),
        metrics_sql(P, keys).strip(),
        f"""e1 AS (SELECT c.site_id, c.candidate_id, c.solar_mw, c.wind_mw, c.bess_power_mw, c.bess_duration_h,
  c.bess_power_mw * c.bess_duration_h AS bess_energy_mwh, c.gas_mw FROM cand c),
e2 AS (SELECT *, {', '.join(f'{dr(v, 2)} AS {n}' for n, v in {**ann, **fom}.items())},
  {dr(total, 2)} AS annualized_total_usd_yr FROM e1),
e3 AS (SELECT e2.*, fixed_om_solar_usd_yr + fixed_om_wind_usd_yr + fixed_om_bess_usd_yr + fixed_om_gas_usd_yr
  AS fixed_om_total_usd_yr, m.* EXCLUDE (site_id, candidate_id, total_gen_mwh, total_clip_mwh, natgas_total_cost_usd,
  grid_imp_mwh, grid_exp_mwh, total_charge_mwh)
  FROM e2 JOIN met m ON m.site_id = e2.site_id AND m.candidate_id = e2.candidate_id),
e4 AS (SELECT *, CASE WHEN horizon_hours > 0 THEN total_operating_cost_usd / horizon_hours * {hy} ELSE {z} END AS opex,
  CASE WHEN horizon_hours > 0 THEN total_served_mwh / horizon_hours * {hy} ELSE {z} END AS served_year FROM e3),
sweep AS (SELECT site_id, candidate_id, NOT infeasible AS ok, '' AS error, solar_mw, wind_mw, bess_power_mw,
  bess_duration_h, bess_energy_mwh, gas_mw, firmness_pct, total_served_mwh, unserved_energy_mwh AS unserved_mwh,
  total_natgas_mwh, co2_tons, merchant_revenue_usd, total_operating_cost_usd AS total_op_cost_usd_horizon,
  cost_unserved_usd, cost_gas_var_usd, cost_gas_no_load_usd, cost_gas_startup_usd, cost_bess_deg_usd,
  cost_carbon_usd, annualized_solar_usd, annualized_wind_usd, annualized_bess_power_usd, annualized_bess_energy_usd,
  annualized_gas_usd, fixed_om_total_usd_yr, annualized_total_usd_yr, {dr('opex', 2)} AS opex_usd_yr,
  {dr('annualized_total_usd_yr + opex', 2)} AS total_annual_cost_usd,
  CASE WHEN served_year > 0 THEN {dr('(annualized_total_usd_yr + opex) / served_year', 2)} END AS lcoe_usd_per_mwh,
  horizon_hours FROM e4)"""])


def ranked_sql(target: float) -> str:
    """CTE ``ranked`` over ``sweep``: meets_reliability, is_pareto, rank."""
    return f"""r0 AS (SELECT *, ok AND firmness_pct >= {d(target)} AS meets_reliability,
  min(CASE WHEN ok THEN total_annual_cost_usd END) OVER (PARTITION BY site_id
    ORDER BY firmness_pct DESC, total_annual_cost_usd ASC, candidate_id ASC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM sweep),
ranked AS (SELECT * EXCLUDE (best_before),
  ok AND (best_before IS NULL OR total_annual_cost_usd < best_before - 1e-6) AS is_pareto,
  CAST(row_number() OVER (PARTITION BY site_id ORDER BY ok DESC, meets_reliability DESC,
    CASE WHEN meets_reliability THEN total_annual_cost_usd END ASC NULLS LAST, firmness_pct DESC,
    total_annual_cost_usd ASC, candidate_id ASC) AS BIGINT) AS rank FROM r0)"""


def recommended_sql(target: float) -> str:
    t = f"{float(target):.1f}"
    money = "format('{:,.0f}', CAST(round(CAST(total_annual_cost_usd AS DECIMAL(38,6)), 0) AS DOUBLE))"
    return f"""rec AS (SELECT *, true AS found,
  CASE WHEN meets_reliability THEN 'target of {t} % met at least cost: ' ELSE 'no candidate reaches {t} %; best: ' END
  || printf('%.2f', firmness_pct) || ' % of load served, $' || {money} || ' a year' AS message
  FROM ranked WHERE rank = 1 AND ok)"""


def gas_sizing_sql(base: Mapping[str, Any], capacities, target: float, grid_on: bool = False) -> str:
    """CTEs ending in ``gsz``: D8 sweep + T3/W8/T4 flags per (site, capacity)."""
    pmin = float(base.get("gas_pmin_mw", 0.0) or 0.0)
    varying = {"gas_pmax_mw": "gas_pmax_mw", "gas_enabled": "true", "gas_dispatchable": "true",
               "gas_pmin_mw": "gas_pmin_mw"}
    P = params(base, varying)
    z = d(0.0)
    fan = f"""gc0 AS (SELECT site_id, unnest({list_sql(capacities)}) AS gas_capacity_mw,
    generate_subscripts({list_sql(capacities)}, 1) - 1 AS candidate_id FROM (SELECT DISTINCT site_id FROM intervals)),
gfan AS (SELECT i.*, CAST(c.candidate_id AS BIGINT) AS candidate_id, c.gas_capacity_mw, c.gas_capacity_mw AS gas_pmax_mw,
    least({d(pmin)}, c.gas_capacity_mw) AS gas_pmin_mw FROM intervals i JOIN gc0 c ON c.site_id = i.site_id)"""
    keys = ["site_id", "candidate_id"]
    return ",\n".join([fan, dispatch_sql(P, "gfan", keys, grid_on).strip(), metrics_sql(P, keys).strip(), f"""gs0 AS (
  SELECT m.site_id, c.gas_capacity_mw, m.firmness_pct, m.merchant_revenue_usd AS merchant_revenue_cost_usd,
    m.total_served_mwh, m.total_gen_mwh, m.total_clip_mwh, m.natgas_total_cost_usd,
    m.total_natgas_mwh AS natgas_generation_mwh, m.infeasible, m.firmness_pct >= {d(target)} AND NOT m.infeasible AS meets_target
  FROM met m JOIN gc0 c ON c.site_id = m.site_id AND c.candidate_id = m.candidate_id),
gs1 AS (SELECT *, abs(coalesce(merchant_revenue_cost_usd - lag(merchant_revenue_cost_usd) OVER w, {z})
      / coalesce(nullif(gas_capacity_mw - lag(gas_capacity_mw) OVER w, {z}), {d(1.0)})) AS slope,
    row_number() OVER w AS pos_ FROM gs0 WINDOW w AS (PARTITION BY site_id ORDER BY gas_capacity_mw)),
gsz AS (SELECT * EXCLUDE (pos_),
    row_number() OVER (PARTITION BY site_id ORDER BY slope DESC, pos_ ASC) = 1 AS is_knee,
    row_number() OVER (PARTITION BY site_id ORDER BY meets_target DESC, gas_capacity_mw ASC) = 1 AS is_recommended
  FROM gs1)"""])


def slack_sql(slacks) -> str:
    """CTEs over ``sweep`` ending in ``slk`` (D9 + J7 + W8/T4)."""
    z = d(0.0)
    return f"""sb AS (SELECT site_id, max(total_served_mwh) AS max_served FROM sweep WHERE ok GROUP BY site_id),
sx AS (SELECT s.*, b.max_served, unnest({list_sql(slacks)}) AS slack, generate_subscripts({list_sql(slacks)}, 1) - 1 AS si
  FROM sweep s JOIN sb b ON b.site_id = s.site_id WHERE s.ok),
sf AS (SELECT *, ({d(1.0)} - slack) * max_served AS served_floor FROM sx),
sk AS (SELECT *, row_number() OVER (PARTITION BY site_id, si ORDER BY merchant_revenue_usd DESC, total_served_mwh DESC,
    candidate_id ASC) AS r_ FROM sf WHERE total_served_mwh >= served_floor - 1e-9),
st1 AS (SELECT site_id, CAST(si AS BIGINT) AS slack_idx, CAST(round(slack * 100) AS BIGINT) AS slack_pct,
    {dr('served_floor', 4)} AS served_floor_mwh, candidate_id, firmness_pct, total_served_mwh, merchant_revenue_usd
  FROM sk WHERE r_ = 1),
st2 AS (SELECT *, abs(coalesce(merchant_revenue_usd - lag(merchant_revenue_usd) OVER w, {z})
    / coalesce(nullif(firmness_pct - lag(firmness_pct) OVER w, {z}), {d(1.0)})) AS slope
  FROM st1 WINDOW w AS (PARTITION BY site_id ORDER BY slack_idx)),
slk AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY slope DESC, slack_idx ASC) = 1 AS is_knee FROM st2)"""


def batch_sql(base: Mapping[str, Any], loads, powers, stacks) -> str:
    """CTEs ending in ``bat``: D12 grid-on runs per (site, load, power, stacks)."""
    combos = [(lv, pw, st) for lv in loads for pw in powers for st in stacks]
    vals = ", ".join(f"({i}, {d(lv)}, {d(pw)}, {int(st)})" for i, (lv, pw, st) in enumerate(combos))
    varying = {"battery_power_mw": "battery_power_mw"}
    P = params(base, varying)
    z = d(0.0)
    keys = ["site_id", "candidate_id"]
    return ",\n".join([f"""bc(candidate_id, load_level_mw, power_mw, stacks) AS (VALUES {vals}),
bz AS (SELECT site_id, sum(abs(coalesce(load_mw, {z}))) < 1e-9 AS load_zero FROM intervals GROUP BY site_id),
bfan AS (SELECT i.site_id, CAST(c.candidate_id AS BIGINT) AS candidate_id, i.ts, i.wind_mw, i.solar_mw, i.natgas_mw,
    CASE WHEN z.load_zero THEN c.load_level_mw ELSE i.load_mw END AS load_mw, i.price,
    c.power_mw * c.stacks AS battery_power_mw
  FROM intervals i JOIN bz z ON z.site_id = i.site_id, bc c)""", dispatch_sql(P, "bfan", keys, grid_on=True).strip(),
        metrics_sql(P, keys).strip(), """bat AS (SELECT m.site_id, c.load_level_mw, c.power_mw, CAST(c.stacks AS INTEGER) AS stacks,
    m.firmness_pct, m.merchant_revenue_usd, m.total_served_mwh, m.grid_imp_mwh, m.grid_exp_mwh, m.total_charge_mwh,
    m.total_natgas_mwh, m.infeasible
  FROM met m JOIN bc c ON c.candidate_id = m.candidate_id)"""])
