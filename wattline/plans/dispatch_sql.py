"""DuckDB statements of the serve-first dispatch (D2-D5), for the oracle.

The text mirrors ``operators.dispatch.serve_first_dispatch`` operation by
operation: constants are pre-computed in Python in the same order Catalyst
folds them, so both engines perform the same IEEE operations and the
per-row results are identical.  The balance is a recursive CTE over the row
number per site.
"""

from __future__ import annotations

import math

from wattline.config import full_config
from wattline.plans.sqlfrag import asdbl, iround, isum


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def gas_constants(cfg: dict) -> dict:
    c = full_config(cfg)
    en, disp = c["gas_enabled"], c["gas_enabled"] and c["gas_dispatchable"]
    if not en:
        var = 0.0
    elif c["gas_cost_mode"] == "advanced":
        var = c["gas_heat_rate_mmbtu_per_mwh"] * c["gas_fuel_price_usd_per_mmbtu"] + c["gas_vom_usd_per_mwh"]
    else:
        var = c["gas_var_cost_usd_per_mwh"]
    co2r = c["gas_heat_rate_mmbtu_per_mwh"] * c["gas_co2_tons_per_mmbtu"] if en else 0.0
    marginal = var + c["carbon_price_usd_per_ton"] * co2r
    noload = c["gas_no_load_cost_usd_per_h"] if en else 0.0
    return dict(c=c, en=en, disp=disp, var=var, co2r=co2r, marginal=marginal, noload=noload,
                gas_ok=disp and marginal < c["voll_usd_per_mwh"])


def prep_sql(cfg: dict, src: str = "intervals") -> str:
    """CTE ``p``: interval rows + gen_ren, gas_cap, pmax_t, pmin_t, must_run, gen, n."""
    k = gas_constants(cfg)
    c = k["c"]
    pmax = c["gas_pmax_mw"] if c["gas_pmax_mw"] > 0 else 0.0
    use = c["gas_use_profile_as_cap"]
    ng = f"greatest({d(0.0)}, coalesce(natgas_mw, {d(0.0)}))"
    if pmax > 0 and not use:
        cap = d(pmax)
    elif use:
        cap = f"least({ng}, {d(pmax)})" if pmax > 0 else ng
    else:
        cap = d(pmax)
    pmax_t = f"greatest({d(0.0)}, least({d(pmax) if pmax > 0 else 'gas_cap'}, gas_cap))"
    if k["disp"]:
        must = d(0.0)
    elif k["en"]:
        if pmax > 0:
            must = f"CASE WHEN ng_zero THEN {d(pmax)} ELSE least({ng}, {d(pmax)}) END"
        else:
            must = ng
    else:
        must = ng
    return f"""
zq AS (SELECT site_id, sum({ng}) <= 1e-9 AS ng_zero FROM {src} GROUP BY site_id),
p0 AS (SELECT i.*, z.ng_zero, coalesce(wind_mw, {d(0.0)}) + coalesce(solar_mw, {d(0.0)}) AS gen_ren, {cap} AS gas_cap,
         row_number() OVER (PARTITION BY i.site_id ORDER BY i.ts) AS n
       FROM {src} i JOIN zq z ON z.site_id = i.site_id),
p1 AS (SELECT *, {pmax_t} AS pmax_t FROM p0),
p AS (SELECT *, least(greatest({d(0.0)}, {d(c['gas_pmin_mw'])}), pmax_t) AS pmin_t, {must} AS must_run,
        gen_ren + ({must}) AS gen FROM p1)"""


def _battery(tag: str, src: str, x: str, p: float, eta: float, dt: float, e: float) -> str:
    step = (f"CASE WHEN {x} >= 0 THEN {d(eta * dt)} * least({d(p)}, {x}) "
            f"ELSE {d(-dt)} * least({d(p)}, -({x})) END")
    return f"""
a{tag} AS (SELECT site_id, n, {step} AS a FROM {src}),
r{tag} AS (SELECT site_id, n, {d(0.0)} AS s0, least({d(e)}, greatest({d(0.0)}, {d(0.0)} + a)) AS s FROM a{tag} WHERE n = 1
      UNION ALL
      SELECT a.site_id, a.n, r.s, least({d(e)}, greatest({d(0.0)}, r.s + a.a))
      FROM r{tag} r JOIN a{tag} a ON a.site_id = r.site_id AND a.n = r.n + 1),
f{tag} AS (SELECT site_id, n, s AS soc{tag}, greatest(s - s0, {d(0.0)}) / {d(eta * dt)} AS charge{tag},
         greatest(-(s - s0), {d(0.0)}) / {d(dt)} AS discharge{tag} FROM r{tag})"""


def serve_first_sql(cfg: dict, *, grid_on: bool = False, two_battery: bool = False, ramp: bool = False,
                    gas_charges_storage: bool = False, commitment: bool = False, src: str = "intervals") -> str:
    """CTE text ending in ``disp`` (one row per site and interval)."""
    k = gas_constants(cfg)
    c = k["c"]
    dt, poi = c["dt_hours"], c["poi_limit_mw"]
    parts = [prep_sql(cfg, src)]
    spare = gas_charges_storage and not grid_on and k["gas_ok"] and (
        k["marginal"] / c["rte"] + c["bess_deg_cost_usd_per_mwh"] < c["voll_usd_per_mwh"])
    parts.append(f"q AS (SELECT *, gen - load_mw{' + pmax_t' if spare else ''} AS x FROM p)")
    parts.append(_battery("1", "q", "x", c["battery_power_mw"], c["rte"], dt,
                          c["battery_power_mw"] * c["battery_duration_h"]))
    parts.append("""q1 AS (SELECT q.*, f1.soc1, f1.charge1, f1.discharge1 FROM q JOIN f1 ON f1.site_id = q.site_id AND f1.n = q.n)""")
    if two_battery:
        parts.append("q1b AS (SELECT *, x - charge1 + discharge1 AS x2 FROM q1)")
        parts.append(_battery("2", "q1b", "x2", c["battery2_power_mw"], c["battery2_rte"], dt,
                              c["battery2_power_mw"] * c["battery2_duration_h"]))
        parts.append("""q2 AS (SELECT q1.*, f2.soc2, f2.charge2, f2.discharge2 FROM q1 JOIN f2 ON f2.site_id = q1.site_id AND f2.n = q1.n)""")
    else:
        parts.append(f"q2 AS (SELECT *, {d(0.0)} AS soc2, {d(0.0)} AS charge2, {d(0.0)} AS discharge2 FROM q1)")
    need = f"greatest({d(0.0)}, load_mw + charge - gen - discharge)"
    if not k["gas_ok"]:
        need_g = d(0.0)
    elif grid_on:
        need_g = f"CASE WHEN {d(k['marginal'])} < price THEN {need} ELSE {d(0.0)} END"
    else:
        need_g = need
    parts.append(f"""q3 AS (SELECT *, charge1 + charge2 AS charge, discharge1 + discharge2 AS discharge FROM q2),
q4 AS (SELECT *, {need_g} AS need FROM q3)""")
    if ramp:
        u, dn = c["gas_ramp_up_mw_per_h"] * dt, c["gas_ramp_down_mw_per_h"] * dt
        parts.append(f"""
rg AS (SELECT site_id, n, least({d(0.0)} + {d(u)}, greatest({d(0.0)} - {d(dn)}, least(pmax_t, need))) AS g FROM q4 WHERE n = 1
      UNION ALL
      SELECT q.site_id, q.n, least(r.g + {d(u)}, greatest(r.g - {d(dn)}, least(q.pmax_t, q.need)))
      FROM rg r JOIN q4 q ON q.site_id = r.site_id AND q.n = r.n + 1),
q5 AS (SELECT q4.*, CASE WHEN rg.g > 1e-6 THEN least(pmax_t, greatest(pmin_t, rg.g)) ELSE {d(0.0)} END AS gas_d
       FROM q4 JOIN rg ON rg.site_id = q4.site_id AND rg.n = q4.n)""")
    else:
        parts.append(f"""q5 AS (SELECT *, CASE WHEN need > 1e-9 THEN greatest(pmin_t, least(pmax_t, need)) ELSE {d(0.0)} END AS gas_d FROM q4)""")
    if commitment:
        periods = lambda h: max(math.ceil(h / dt), 1) if h > 0 and k["disp"] else 1
        up, dn = periods(c["gas_min_up_h"]), periods(c["gas_min_down_h"])
        parts[-1] = parts[-1].replace("q5 AS (", "q5a AS (")
        step = lambda s, w: (
            f"CASE WHEN {s} > 0 THEN CASE WHEN {w} OR {s} < {up} THEN least({s} + 1, {up}) ELSE -1 END "
            f"ELSE CASE WHEN {w} AND -({s}) >= {dn} THEN 1 ELSE -least(1 - ({s}), {dn}) END END")
        parts.append(f"""
cw AS (SELECT site_id, n, must_run + gas_d > 1e-6 AS w FROM q5a),
cs AS (SELECT site_id, n, CAST({step('-1000000', 'w')} AS INTEGER) AS s FROM cw WHERE n = 1
      UNION ALL
      SELECT w.site_id, w.n, CAST({step('c.s', 'w.w')} AS INTEGER) FROM cs c JOIN cw w ON w.site_id = c.site_id AND w.n = c.n + 1),
q5 AS (SELECT q5a.* EXCLUDE (gas_d), CASE WHEN cs.s > 0 THEN {d(1.0)} ELSE {d(0.0)} END AS committed,
         CASE WHEN {'true' if k['disp'] else 'false'} AND cs.s > 0 THEN least(pmax_t, greatest(pmin_t, gas_d)) ELSE {d(0.0)} END AS gas_d
       FROM q5a JOIN cs ON cs.site_id = q5a.site_id AND cs.n = q5a.n)""")
    parts.append("q6 AS (SELECT *, gen + gas_d + discharge - charge AS supply FROM q5)")
    if grid_on:
        parts.append(f"""q7 AS (SELECT *, greatest({d(0.0)}, load_mw - supply) AS grid_imp,
        greatest({d(0.0)}, supply - load_mw) AS surplus FROM q6),
q8 AS (SELECT *, least({d(poi)}, surplus) AS grid_exp, load_mw AS serve, grid_imp > {d(poi + 1e-9)} AS infeasible FROM q7),
q9 AS (SELECT *, surplus - grid_exp AS clipped FROM q8)""")
    else:
        parts.append(f"""q8 AS (SELECT *, least(load_mw, supply) AS serve, {d(0.0)} AS grid_imp, {d(0.0)} AS grid_exp,
        false AS infeasible FROM q6),
q9 AS (SELECT *, greatest({d(0.0)}, supply - serve) AS clipped FROM q8)""")
    disp_flag = "true" if k["disp"] else "false"
    parts.append(f"""q10 AS (SELECT *, must_run + gas_d AS gas_gen, gen_ren + must_run + gas_d AS generation,
        load_mw AS load, price / 1000 AS price_per_kwh, load_mw - serve AS unserved, soc1 + soc2 AS soc,
        grid_exp - grid_imp AS net_to_grid FROM q9),
q11 AS (SELECT *, {'committed' if commitment else f'CASE WHEN gas_gen > 1e-6 THEN {d(1.0)} ELSE {d(0.0)} END'} AS gas_on FROM q10),
q12 AS (SELECT *, lag(gas_on) OVER (PARTITION BY site_id ORDER BY ts) AS on_prev FROM q11),
q13 AS (SELECT *, CASE WHEN gas_on > 0 AND coalesce(on_prev, {d(0.0)}) <= 0 THEN {d(1.0)} ELSE {d(0.0)} END AS gas_start,
        CASE WHEN {disp_flag} AND gas_on <= 0 AND coalesce(on_prev, {d(0.0)}) > 0 THEN {d(1.0)} ELSE {d(0.0)} END AS gas_stop
        FROM q12),
disp AS (SELECT *, gas_gen * {d(k['var'])} * {d(dt)} + gas_start * {d(c['gas_startup_cost_usd'])}
        + gas_on * {d(k['noload'])} * {d(dt)} AS gas_cost FROM q13)""")
    return ",\n".join(x.strip() for x in parts)


def run_metrics_sql(cfg: dict, *, grid_allowed: bool = False) -> str:
    """SELECT over ``disp`` mirroring ``operators.metrics.run_metrics`` (flat columns)."""
    k = gas_constants(cfg)
    c = k["c"]
    dt = d(c["dt_hours"])
    e1 = c["battery_power_mw"] * c["battery_duration_h"]
    e2 = c["battery2_power_mw"] * c["battery2_duration_h"]
    pmax = c["gas_pmax_mw"]

    from wattline.plans.sqlfrag import dr

    def ds(x: str) -> str:
        return isum(x)

    def rn(x: str, n: int = 2) -> str:
        return iround(x, n)

    def pct(num: str, den: str) -> str:
        return f"CASE WHEN {den} > 0 THEN ({num}) / {den} * 100 ELSE {d(0.0)} END"

    g = f"""g AS (SELECT site_id, count(*) AS n_, {ds('load * ' + dt)} AS ld, {ds('serve * ' + dt)} AS sv,
   {ds('unserved * ' + dt)} AS us, {ds('(grid_exp - grid_imp) * price * ' + dt)} AS mer, {ds('gas_cost')} AS gc,
   {ds('wind_mw * ' + dt)} AS wi, {ds('solar_mw * ' + dt)} AS so, {ds('gas_gen * ' + dt)} AS ng,
   {ds('charge * ' + dt)} AS ch, {ds('clipped * ' + dt)} AS cl, {ds('generation * ' + dt)} AS gn,
   {ds('grid_imp * ' + dt)} AS im, {ds('grid_exp * ' + dt)} AS ex, {ds('discharge1 * ' + dt)} AS d1,
   {ds('discharge2 * ' + dt)} AS d2, {ds('clipped * price * ' + dt)} AS cr, sum(gas_start) AS st, sum(gas_on) AS onn,
   max(gas_cap) AS capmax, min(soc1) AS s1n, max(soc1) AS s1x, min(soc2) AS s2n, max(soc2) AS s2x, min(clipped) AS cln,
   max(abs(grid_imp)) AS imx, max(abs(grid_exp)) AS exx, {ds('serve')} AS svp,
   {ds(f'greatest(wind_mw, {d(0.0)}) + greatest(solar_mw, {d(0.0)}) + greatest(gas_gen, {d(0.0)})')} AS avp,
   max(CAST(infeasible AS INTEGER)) AS inf FROM disp GROUP BY site_id)"""
    natgas = asdbl("ng")
    co2 = f"({d(k['co2r'])} * {natgas})"
    starts = "CAST(round(st) AS BIGINT)"
    cap_ref = d(pmax) if pmax > 0 else f"coalesce(capmax, {d(0.0)})"
    horizon = f"(n_ * {dt})"
    parts = {
        "cost_unserved_usd": f"{d(c['voll_usd_per_mwh'])} * {asdbl('us')}",
        "cost_gas_var_usd": f"{d(k['var'])} * {natgas}",
        "cost_gas_no_load_usd": f"{d(k['noload'])} * onn * {dt}",
        "cost_gas_startup_usd": f"{d(c['gas_startup_cost_usd'])} * {starts}",
        "cost_bess_deg_usd": f"{d(c['bess_deg_cost_usd_per_mwh'])} * ({asdbl('d1')} + {asdbl('d2')})",
        "cost_carbon_usd": f"{d(c['carbon_price_usd_per_ton'])} * {co2}",
    }
    total = " + ".join(f"({v})" for v in parts.values())
    # left-associated sum in the same order as the Spark expression
    vals = list(parts.values())
    total = f"({vals[0]})"
    for v in vals[1:]:
        total = f"({total} + ({v}))"
    errs = [
        (f"(s1n < -1e-6) OR (s1x > {d(e1 + 1e-6)})", "soc1_bounds"),
        (f"(s2n < -1e-6) OR (s2x > {d(e2 + 1e-6)})", "soc2_bounds"),
        ("cln < -1e-6", "clip_below_zero"),
    ]
    if not grid_allowed:
        errs += [("(imx > 1e-6) OR (exx > 1e-6)", "grid_flow_off"),
                 (f"{asdbl('svp')} > {asdbl('avp')} + 1e-6", "served_over_supply")]
    err = "concat_ws('; ', " + ", ".join(f"CASE WHEN {cnd} THEN '{m}' END" for cnd, m in errs) + ")"
    clip_rev = rn("cr") if not grid_allowed else "CAST(NULL AS DOUBLE)"
    return f""", {g}
SELECT site_id,
  {dr(pct(asdbl('sv'), asdbl('ld')), 2)} AS firmness_pct,
  {dr(pct(asdbl('wi') + ' + ' + asdbl('so') + ' + ' + natgas, asdbl('ld')), 2)} AS total_gen_over_load_pct,
  {dr(pct(asdbl('wi') + ' + ' + asdbl('so'), asdbl('ld')), 2)} AS renewable_gen_over_load_pct,
  {rn('mer - gc')} AS merchant_revenue_usd, {rn('ch')} AS total_charge_mwh, {rn('cl')} AS total_clip_mwh,
  {rn('gn')} AS total_gen_mwh, {rn('ld')} AS total_load_mwh, {rn('sv')} AS total_served_mwh,
  {rn('us', 4)} AS unserved_energy_mwh, {rn('im')} AS grid_imp_mwh, {rn('ex')} AS grid_exp_mwh,
  {dr(f"CASE WHEN {d(e1)} > 0 THEN {asdbl('d1')} / {d(e1)} ELSE {d(0.0)} END", 2)} AS cycles_battery1,
  {dr(f"CASE WHEN {d(e2)} > 0 THEN {asdbl('d2')} / {d(e2)} ELSE {d(0.0)} END", 2)} AS cycles_battery2,
  {rn('wi')} AS total_wind_mwh, {rn('so')} AS total_solar_mwh, {rn('ng')} AS total_natgas_mwh,
  {starts} AS natgas_start_count,
  {dr(f"CASE WHEN ({cap_ref}) > 0 AND {horizon} > 0 THEN 100.0 * {natgas} / (({cap_ref}) * {horizon}) ELSE {d(0.0)} END", 2)}
    AS natgas_capacity_factor_pct,
  {rn('gc')} AS natgas_total_cost_usd, {dr(co2, 3)} AS co2_tons, {dr(total, 2)} AS total_operating_cost_usd,
  {', '.join(f'{dr(v, 2)} AS {n}' for n, v in parts.items())},
  {dr(horizon, 4)} AS horizon_hours, {dt} AS dt_hours, {clip_rev} AS clipped_revenue_usd,
  {err} AS sanity_check_errors, {err} = '' AS sanity_check_passed, inf > 0 AS infeasible
FROM g"""
