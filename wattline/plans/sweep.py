"""Capacity screening as one Spark plan.

    ranges --(F12 resolve per site, J1 product)--> candidates
    intervals x candidates of the site as lanes (J2)
      -> scale renewables (P12) -> candidate config (J4) -> serve-first dispatch (D2, D3)
      -> run metrics per (site, candidate) -> economics (J5, F1-F4)
      -> reliability flag (P25), Pareto flag (W7), rank (T1), recommendation (T2)

Each site is screened on its own.  The candidate grid is built with
``posexplode`` generators (no cross join).  The intervals are stored once as time
chunks; candidates are lanes over them (``operators.lanes``), and only the sums of
a lane's chunk leave a task.  Every plan takes interval rows, or the chunks that
``operators.lanes.stored_chunks`` made of them, for plans that share them.
"""

from __future__ import annotations

import math
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.econ import annual_figures, annualized_cost, econ_columns, with_econ
from wattline.functions.text import money_text
from wattline.operators.balance import stored
from wattline.operators.lanes import lane_dispatch, lane_metrics, site_facts, stored_chunks, windowed_chunks
from wattline.operators.metrics import metrics_of
from wattline.operators.series import ranged, row_numbers

RANGE_NAMES = ["solar", "wind", "bess_power", "bess_duration", "gas"]
CAND_COLS = ["solar_mw", "wind_mw", "bess_power_mw", "bess_duration_h", "gas_mw"]
RANGE_TYPE = T.StructType([T.StructField("name", T.StringType()), T.StructField("mode", T.StringType()),
                           T.StructField("values", T.ArrayType(T.DoubleType())),
                           T.StructField("reference_mw", T.DoubleType())])
KEYS = ["site_id", "candidate_id"]
#: Facts of a site that its candidates' lanes need.
LANE_FACTS = ["ref_solar_mw", "ref_wind_mw", "_ng_zero"]


def ranges_row(ranges: Mapping[str, Mapping[str, Any]]) -> list[Column]:
    """Literal range structs, one column per resource."""
    cols = []
    for n in RANGE_NAMES:
        r = ranges[n]
        cols.append(F.struct(F.lit(n).alias("name"), F.lit(r["mode"]).alias("mode"),
                             F.array(*[F.lit(float(v)) for v in r["values"]]).cast("array<double>").alias("values"),
                             F.lit(r.get("reference_mw")).cast("double").alias("reference_mw")).alias(n))
    return cols


def resolve(rng: Column, reference: Column | None = None) -> Column:
    """candidate values of one range.

    ``multipliers`` scale the reference MW (the range's own, else the site's
    detected one); no positive reference -> [0].  Other modes: values as is.
    """
    ref = F.coalesce(rng["reference_mw"], reference) if reference is not None else rng["reference_mw"]
    return F.when(rng["mode"] == "multipliers",
                  F.when(ref > 0, F.transform(rng["values"], lambda v: v * ref))
                  .otherwise(F.array(F.lit(0.0)))).otherwise(rng["values"])


def _grid_lists(sites: DataFrame, ranges: Mapping[str, Mapping[str, Any]] | None, part: Sequence[str],
                keep: Sequence[str] = ()) -> DataFrame:
    """part, the columns in ``keep``, the five resolved value lists (_v_*) and the size of their product.

    Without ``ranges`` the sites' rows carry them as ``screening_ranges``.
    """
    rng = ranges_row(ranges) if ranges is not None else [F.col(f"screening_ranges.{n}").alias(n) for n in RANGE_NAMES]
    d = sites.select(*part, *rng, *dict.fromkeys(["ref_solar_mw", "ref_wind_mw", *keep]))
    refs = {"solar": F.col("ref_solar_mw"), "wind": F.col("ref_wind_mw")}
    d = d.select(*part, *keep, *[resolve(F.col(n), refs.get(n)).alias(f"_v_{k}") for n, k in zip(RANGE_NAMES, CAND_COLS)])
    size = F.lit(1).cast("long")
    for k in CAND_COLS:
        size = size * F.greatest(F.size(f"_v_{k}"), F.lit(1))
    return d.withColumn("grid_size", size)


def candidate_grid(sites: DataFrame, ranges: Mapping[str, Mapping[str, Any]] | None = None, cap: int | None = None,
                   part: Sequence[str] = ("site_id",), keep: Sequence[str] = ()) -> DataFrame:
    """The product of the five resolved ranges per site, ``candidate_id`` mixed-radix.

    ``sites`` has ``part``, ref_solar_mw, ref_wind_mw.  A site whose product is
    larger than ``cap`` (default: no limit) is left out before anything is
    expanded; ``over_cap`` has it.  ``keep`` are columns of the site that its candidates keep.
    """
    part = list(part)
    d = _grid_lists(sites, ranges, part, keep)
    if cap is not None:
        d = d.where(F.col("grid_size") <= cap)
    cid = F.lit(0).cast("long")
    for k in CAND_COLS:
        d = d.select("*", F.posexplode(f"_v_{k}").alias(f"_i_{k}", k))
        cid = cid * F.size(f"_v_{k}") + F.col(f"_i_{k}")
    return d.select(*part, cid.alias("candidate_id"), *CAND_COLS, "grid_size", *keep)


def over_cap(sites: DataFrame, ranges: Mapping[str, Mapping[str, Any]] | None, cap: int,
             part: Sequence[str] = ("site_id",)) -> DataFrame:
    """Sites whose grid is larger than ``cap``: one failed row each."""
    d = _grid_lists(sites, ranges, list(part)).where(F.col("grid_size") > cap)
    return d.select(*part, F.lit(False).alias("ok"), F.concat(
        F.lit("grid of "), F.col("grid_size").cast("string"), F.lit(f" candidates is over the limit of {cap}")).alias("error"))


def candidate_config(cands: DataFrame, base: Mapping[str, Any]) -> tuple[DataFrame, dict]:
    """Candidate values override the base configuration.

    Returns the candidate table with the varying parameter columns and the
    base configuration (literal for all other fields) marking them varying.
    """
    pmin = float(base.get("gas_pmin_mw", 0.0) or 0.0)
    c = F.col
    out = cands.withColumns({
        "battery_power_mw": c("bess_power_mw"), "battery_duration_h": c("bess_duration_h"),
        "gas_pmax_mw": c("gas_mw"), "gas_enabled": c("gas_mw") > 0, "gas_dispatchable": c("gas_mw") > 0,
        "gas_pmin_mw": F.least(F.lit(pmin), c("gas_mw")),
        "bess_energy_mwh": c("bess_power_mw") * c("bess_duration_h"),
    })
    cfg = dict(base, _varying=("battery_power_mw", "battery_duration_h", "gas_pmax_mw", "gas_enabled",
                               "gas_dispatchable", "gas_pmin_mw"))
    return out, cfg


def reference_mw(iv: DataFrame) -> DataFrame:
    """A24 per site."""
    def ref(c):
        return F.coalesce(F.ceil(F.max(F.greatest(F.col(c), F.lit(0.0)))).cast("double"), F.lit(0.0))
    return iv.groupBy("site_id").agg(ref("solar_mw").alias("ref_solar_mw"), ref("wind_mw").alias("ref_wind_mw"))


def chunks_of(iv: DataFrame, cfg: Mapping[str, Any] | None = None) -> DataFrame:
    """The stored chunks of interval rows; chunks stay as they are."""
    return iv if "_rows" in iv.columns else stored_chunks(iv, float((cfg or {}).get("dt_hours", 1.0)))


def most_candidates(ranges: Mapping[str, Mapping[str, Any]]) -> int:
    """The largest grid that literal ranges give a site."""
    return math.prod(max(len(ranges[n]["values"]), 1) for n in RANGE_NAMES)


def sweep_lanes(cands: DataFrame) -> DataFrame:
    """The candidates as lanes, with the factors that scale the site's profiles
    (P12); ``cands`` with their site's ``LANE_FACTS``."""
    c = F.col
    factor = lambda x, r: F.when(c(r) > 0, c(x) / c(r)).otherwise(F.lit(0.0))
    return cands.withColumns({"_sk": factor("cand_solar_mw", "ref_solar_mw"), "_wk": factor("cand_wind_mw", "ref_wind_mw"),
                          "_load": F.lit(None).cast("double")}).drop(
        "ref_solar_mw", "ref_wind_mw", "cand_solar_mw", "cand_wind_mw")


SWEEP_COLUMNS = ["site_id", "candidate_id", "ok", "error", "solar_mw", "wind_mw", "bess_power_mw",
                 "bess_duration_h", "bess_energy_mwh", "gas_mw", "firmness_pct", "total_served_mwh", "unserved_mwh",
                 "total_natgas_mwh", "co2_tons", "merchant_revenue_usd", "total_op_cost_usd_horizon",
                 "cost_unserved_usd", "cost_gas_var_usd", "cost_gas_no_load_usd", "cost_gas_startup_usd",
                 "cost_bess_deg_usd", "cost_carbon_usd", "annualized_solar_usd", "annualized_wind_usd",
                 "annualized_bess_power_usd", "annualized_bess_energy_usd", "annualized_gas_usd",
                 "fixed_om_total_usd_yr", "annualized_total_usd_yr", "opex_usd_yr", "total_annual_cost_usd",
                 "lcoe_usd_per_mwh", "horizon_hours"]


def capacity_sweep(iv: DataFrame, base: Mapping[str, Any], ranges: Mapping[str, Any],
                   econ: Mapping[str, Any] | None = None, *, cap: int | None = None,
                   grid_allowed: bool = False) -> DataFrame:
    """One row per (site, candidate): metrics, costs and economics.

    ``ok`` is false where the import of some interval exceeds the connection
    (grid on), and for a site whose grid is larger than ``cap``: that one has
    a single row with an ``error`` and without a candidate.
    """
    chunks = chunks_of(iv, base)
    facts = stored(site_facts(chunks), "facts")
    grid = candidate_grid(facts, ranges, cap)
    cands, cfg = candidate_config(candidate_grid(facts, ranges, cap, keep=LANE_FACTS).withColumnsRenamed(
        {"solar_mw": "cand_solar_mw", "wind_mw": "cand_wind_mw"}), base)
    lanes = sweep_lanes(cands.drop("bess_power_mw", "bess_duration_h", "gas_mw", "bess_energy_mwh", "grid_size"))
    m = metrics_of(lane_metrics(chunks, lanes, KEYS, cfg, grid_allowed, most_candidates(ranges)), KEYS,
                   grid_allowed=grid_allowed)
    info = grid.withColumn("bess_energy_mwh", F.col("bess_power_mw") * F.col("bess_duration_h"))
    # One screening scenario -> its economics are literal columns (no join)
    # merged: Spark takes the grid for as small as the facts it is made from, and would send all candidates to the driver
    out = sweep_rows(with_econ(info, econ).join(m.hint("merge"), KEYS))
    if cap is not None:
        out = out.unionByName(over_cap(facts, ranges, cap), allowMissingColumns=True)
    return out


def sweep_rows(rows: DataFrame, part: Sequence[str] = ("site_id",)) -> DataFrame:
    """The sweep table from candidates with their metrics and economics."""
    rows = rows.withColumns({"ok": ~F.col("infeasible"), "error": F.lit(""),
                             "unserved_mwh": F.col("unserved_energy_mwh"),
                             "total_op_cost_usd_horizon": F.col("total_operating_cost_usd")})
    rows = annual_figures(annualized_cost(rows))
    return rows.select(*[p for p in part if p not in SWEEP_COLUMNS], *SWEEP_COLUMNS)


def score_and_rank(sweep: DataFrame, target_pct: float | Column, part: Sequence[str] = ("site_id",)) -> DataFrame:
    """P25 + W7 + T1: reliability flag, Pareto flag and rank per site.

    Pareto: in (firmness desc, cost asc) order a row is on the frontier when
    its cost is below every cost seen before it by more than 1e-6 (first row:
    yes).  Failed rows (ok = false) are neither reliable nor Pareto and rank
    behind all others.  Rank: reliable rows by cost, then the others by
    firmness, ties by candidate_id.

    The sweep is stored once, with a number for each row; what the order needs
    of it is stored in ranges of the rank's order, so the sampling of the ranges
    doesn't work out the sweep once more.  Ranks are places in a range plus the
    sizes of the ranges before; a range hands on only the rows that lower its
    least cost so far, and the site's frontier is found among those.  No task
    holds a site's whole grid, and the wide rows move once, to meet their ranks.
    """
    c = F.col
    part = list(part)
    target = target_pct if isinstance(target_pct, Column) else F.lit(float(target_pct))
    d = sweep.withColumn("meets_reliability", c("ok") & F.coalesce(c("firmness_pct") >= target, F.lit(False)))
    order = [c("ok").desc(), c("meets_reliability").desc(),
             F.when(c("meets_reliability"), c("total_annual_cost_usd")).asc_nulls_last(), c("firmness_pct").desc(),
             c("total_annual_cost_usd").asc(), c("candidate_id").asc()]
    rows = stored(d.withColumn("_id", F.monotonically_increasing_id()), "sweep")
    d = ranged(rows.select(*dict.fromkeys([*part, "_id", "candidate_id", "ok", "meets_reliability", "firmness_pct",
                                           "total_annual_cost_usd"])), part, order, "ranges")
    cost, lower = c("total_annual_cost_usd"), Window.unboundedPreceding
    firm = [c("firmness_pct").desc(), cost.asc(), c("candidate_id").asc()]
    best = lambda by: F.min(cost).over(Window.partitionBy(*by).orderBy(*firm).rowsBetween(lower, -1))
    fine = d.where("ok").select(*part, "_p", "candidate_id", "firmness_pct", "total_annual_cost_usd")
    steps = fine.withColumn("_best", best([*part, "_p"])).where(c("_best").isNull() | (cost < c("_best")))
    front = (steps.withColumn("_best", best(part)).where(c("_best").isNull() | (cost < c("_best") - F.lit(1e-6)))
             .select(*part, "candidate_id", F.lit(True).alias("is_pareto")))
    ranks = stored(row_numbers(d, part, order, "rank").join(front, [*part, "candidate_id"], "left").select(
        "_id", F.coalesce("is_pareto", F.lit(False)).alias("is_pareto"), "rank"), "ranks")
    return rows.join(ranks.hint("merge"), "_id").select(*sweep.columns, "meets_reliability", "is_pareto", "rank")


def recommend(ranked: DataFrame, target_pct: float | Column, sites: DataFrame | None = None,
              part: Sequence[str] = ("site_id",)) -> DataFrame:
    """T2 + F8: the rank-1 row per site that didn't fail, with a sentence on why.

    Rank 1 is the cheapest reliable configuration, else the most reliable
    (then cheapest) one.  With ``sites`` every site gets a row: ``found`` is
    false where no candidate could be run.
    """
    c = F.col
    target = F.format_string("%.1f", target_pct if isinstance(target_pct, Column) else F.lit(float(target_pct)))
    top = ranked.where((c("rank") == 1) & c("ok"))
    facts = F.concat(F.format_string("%.2f", c("firmness_pct")), F.lit(" % of load served, $"),
                     money_text(c("total_annual_cost_usd")), F.lit(" a year"))
    msg = F.concat(F.when(c("meets_reliability"), F.lit("target of ")).otherwise(F.lit("no candidate reaches ")), target,
                   F.when(c("meets_reliability"), F.lit(" % met at least cost: ")).otherwise(F.lit(" %; best: ")), facts)
    top = top.withColumns({"found": F.lit(True), "message": msg})
    if sites is not None:
        top = sites.select(*part).join(top, list(part), "left").withColumns({
            "found": F.coalesce(c("found"), F.lit(False)), "message": F.coalesce(c("message"), F.lit("no candidate"))})
    return top


def pareto_frontier(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("is_pareto"))


def drilldown(iv: DataFrame, rec: DataFrame, base: Mapping[str, Any], grid_allowed: bool = False) -> DataFrame:
    """The dispatch of each site's recommended candidate, and of no other."""
    chunks = chunks_of(iv, base)
    cands, cfg = candidate_config(rec.select("site_id", "candidate_id", F.col("solar_mw").alias("cand_solar_mw"),
                                             F.col("wind_mw").alias("cand_wind_mw"), "bess_power_mw", "bess_duration_h",
                                             "gas_mw"), base)
    facts = site_facts(chunks).select("site_id", *LANE_FACTS)
    lanes = sweep_lanes(cands.drop("bess_power_mw", "bess_duration_h", "gas_mw", "bess_energy_mwh").join(
        facts.hint("shuffle_hash"), "site_id"))
    return lane_dispatch(chunks, lanes, KEYS, cfg, grid_allowed, most_lanes=1)


# ---------------------------------------------------------------------------
# D8 gas capacity sweep and sizing recommendation
# ---------------------------------------------------------------------------

def gas_capacity_sweep(iv: DataFrame, base: Mapping[str, Any], capacities: Sequence[float],
                       target_pct: float | None, grid_allowed: bool = False) -> DataFrame:
    """Dispatch per gas capacity (gas enabled + dispatchable), metrics per (site, capacity)."""
    c = F.col
    # capacities: a short parameter list, expanded per site by a generator
    arr = F.array(*[F.lit(float(x)) for x in capacities])
    chunks = chunks_of(iv, base)
    cands = site_facts(chunks).select("site_id", "_ng_zero", F.posexplode(arr).alias("candidate_id", "gas_capacity_mw"))
    pmin = float(base.get("gas_pmin_mw", 0.0) or 0.0)
    none = F.lit(None).cast("double")
    lanes = cands.withColumns({
        "candidate_id": c("candidate_id").cast("long"), "gas_pmax_mw": c("gas_capacity_mw"), "gas_enabled": F.lit(True),
        "gas_dispatchable": F.lit(True), "gas_pmin_mw": F.least(F.lit(pmin), c("gas_capacity_mw")),
        "_sk": none, "_wk": none, "_load": none})
    cfg = dict(base, _varying=("gas_pmax_mw", "gas_enabled", "gas_dispatchable", "gas_pmin_mw"))
    keys = [*KEYS, "gas_capacity_mw"]
    m = metrics_of(lane_metrics(chunks, lanes, keys, cfg, grid_allowed, len(capacities)), keys, grid_allowed=grid_allowed)
    out = m.select(
        "site_id", "gas_capacity_mw", "firmness_pct", c("merchant_revenue_usd").alias("merchant_revenue_cost_usd"),
        "total_served_mwh", "total_gen_mwh", "total_clip_mwh", "natgas_total_cost_usd",
        c("total_natgas_mwh").alias("natgas_generation_mwh"), "infeasible")
    meets = c("firmness_pct") >= F.lit(float(target_pct)) if target_pct is not None else F.lit(False)
    return out.withColumn("meets_target", meets & ~c("infeasible"))


def recommend_gas_capacity(sweep: DataFrame, target_pct: float | None) -> DataFrame:
    """T3 + W8 + T4 per site: recommended capacity (smallest meeting the target, else the
    smallest tested), marginal merchant slope per MW and the knee (first largest slope)."""
    c = F.col
    w = Window.partitionBy("site_id").orderBy("gas_capacity_mw")
    d_rev = F.coalesce(c("merchant_revenue_cost_usd") - F.lag("merchant_revenue_cost_usd").over(w), F.lit(0.0))
    d_cap = F.coalesce(F.nullif(c("gas_capacity_mw") - F.lag("gas_capacity_mw").over(w), F.lit(0.0)), F.lit(1.0))
    d = sweep.withColumns({"slope": F.abs(d_rev / d_cap), "_pos": F.row_number().over(w)})
    wk = Window.partitionBy("site_id").orderBy(c("slope").desc(), c("_pos").asc())
    meet_first = Window.partitionBy("site_id").orderBy(c("meets_target").desc(), c("gas_capacity_mw").asc())
    d = d.withColumns({"is_knee": F.row_number().over(wk) == 1})
    if target_pct is not None:
        d = d.withColumn("is_recommended", F.row_number().over(meet_first) == 1)
    else:
        d = d.withColumn("is_recommended", c("_pos") == 1)
    return d.drop("_pos")


# ---------------------------------------------------------------------------
# D9 slack trade-off over the sweep table
# ---------------------------------------------------------------------------
# --- fixed values: default slack list (fractions) ---------------------------
DEFAULT_SLACKS = [0.00, 0.01, 0.02, 0.03, 0.05, 0.06, 0.07, 0.09]
# --- end fixed values ---------------------------------------------------------


def slack_tradeoff(sweep: DataFrame, slacks: Sequence[float] = DEFAULT_SLACKS) -> DataFrame:
    """D9 + J7 + W8/T4: for each slack, the served floor (1 - slack) x best served, and
    the sweep row with the highest merchant value among rows meeting it; knee flag.

    The slack list is a short parameter array expanded by a generator; the
    floor test is the range (theta) predicate applied after it.
    """
    c = F.col
    sweep = stored(sweep.where("ok").select("site_id", "candidate_id", "firmness_pct", "total_served_mwh",
                                            "merchant_revenue_usd"), "served")
    best = sweep.groupBy("site_id").agg(F.max("total_served_mwh").alias("max_served"))
    d = sweep.join(best.hint("shuffle_hash"), "site_id")
    d = d.select("*", F.posexplode(F.array(*[F.lit(float(s)) for s in slacks])).alias("_si", "slack"))
    d = d.withColumn("served_floor", (F.lit(1.0) - c("slack")) * c("max_served"))
    d = d.where(c("total_served_mwh") >= c("served_floor") - F.lit(1e-9))
    w = Window.partitionBy("site_id", "_si").orderBy(c("merchant_revenue_usd").desc(), c("total_served_mwh").desc(),
                                                      c("candidate_id").asc())
    top = d.withColumn("_r", F.row_number().over(w)).where(c("_r") == 1)
    top = top.select("site_id", c("_si").cast("long").alias("slack_idx"),
                     F.round(c("slack") * 100).cast("long").alias("slack_pct"),
                     F.round(c("served_floor").cast("decimal(38,6)"), 4).cast("double").alias("served_floor_mwh"),
                     "candidate_id", "firmness_pct", "total_served_mwh", "merchant_revenue_usd")
    ws = Window.partitionBy("site_id").orderBy("slack_idx")
    d_rev = F.coalesce(c("merchant_revenue_usd") - F.lag("merchant_revenue_usd").over(ws), F.lit(0.0))
    d_f = F.coalesce(F.nullif(c("firmness_pct") - F.lag("firmness_pct").over(ws), F.lit(0.0)), F.lit(1.0))
    top = top.withColumn("slope", F.abs(d_rev / d_f))
    wk = Window.partitionBy("site_id").orderBy(c("slope").desc(), c("slack_idx").asc())
    return top.withColumn("is_knee", F.row_number().over(wk) == 1)


# ---------------------------------------------------------------------------
# D12 batch grid
# ---------------------------------------------------------------------------

def batch_grid(iv: DataFrame, base: Mapping[str, Any], loads: Sequence[float], powers: Sequence[float],
               stacks: Sequence[int]) -> DataFrame:
    """Metrics for every (load level, battery power, stack count) per site, grid on.

    The combinations are a short literal array, expanded on each site's row.
    Battery power is power x stacks; the load level stands in for a load column
    that is empty (P11).
    """
    c = F.col
    combos = [(lv, pw, st) for lv in loads for pw in powers for st in stacks]
    arr = F.array(*[F.struct(F.lit(i).cast("long").alias("candidate_id"), F.lit(float(lv)).alias("load_level_mw"),
                             F.lit(float(pw)).alias("power_mw"), F.lit(int(st)).alias("stacks"))
                    for i, (lv, pw, st) in enumerate(combos)])
    chunks = chunks_of(iv, base)
    none = F.lit(None).cast("double")
    lanes = site_facts(chunks).select("site_id", "_load_zero", "_ng_zero", F.inline(arr)).withColumns({
        "_sk": none, "_wk": none, "_load": F.when(c("_load_zero"), c("load_level_mw")),
        "battery_power_mw": c("power_mw") * c("stacks")}).drop("_load_zero")
    cfg = dict(base, _varying=("battery_power_mw",))
    keys = [*KEYS, "load_level_mw", "power_mw", "stacks"]
    m = metrics_of(lane_metrics(chunks, lanes, keys, cfg, True, len(combos)), keys, grid_allowed=True)
    return m.select("site_id", "load_level_mw", "power_mw", "stacks", "firmness_pct", "merchant_revenue_usd",
                    "total_served_mwh", "grid_imp_mwh", "grid_exp_mwh", "total_charge_mwh", "total_natgas_mwh", "infeasible")


# ---------------------------------------------------------------------------
# D11 screening by scenarios
# ---------------------------------------------------------------------------

def scenario_screening(iv: DataFrame, site_scenarios: DataFrame) -> DataFrame:
    """Every site screened by its own scenario: window (P1), synthetic
    load (P11), configuration, economics, ranges, target and grid from its row.

    ``site_scenarios`` has site_id and the columns of ``sources.scenarios.read_scenarios``.
    Returns the ranked sweep with ``scenario`` and ``target_pct``; a site
    without an interval in its window has no rows.
    """
    c = F.col
    site_scenarios = stored(site_scenarios, "scenarios")
    chunks = windowed_chunks(chunks_of(iv), site_scenarios)
    facts = stored(site_facts(chunks), "facts")
    given = {"scenario": c("name"), "target_pct": c("reliability_target_pct"), "grid_allowed": c("grid_allowed"),
             "run_config": c("run_config"), "econ": c("econ")}
    sites = facts.select("site_id", *LANE_FACTS).join(site_scenarios.select(
        "site_id", "screening_ranges", *[v.alias(n) for n, v in given.items()]).hint("shuffle_hash"), "site_id")
    cands = stored(candidate_grid(sites, None, keep=[*LANE_FACTS, *given]), "candidates")
    sizes = {"battery_power_mw": c("bess_power_mw"), "battery_duration_h": c("bess_duration_h"), "gas_pmax_mw": c("gas_mw"),
             "gas_enabled": c("gas_mw") > 0, "gas_dispatchable": c("gas_mw") > 0,
             "gas_pmin_mw": F.least(c("run_config.gas_pmin_mw"), c("gas_mw"))}
    names = [f.name for f in cands.schema["run_config"].dataType]
    lanes = sweep_lanes(cands.select(
        "site_id", "candidate_id", "grid_allowed", c("solar_mw").alias("cand_solar_mw"), c("wind_mw").alias("cand_wind_mw"),
        *[sizes.get(n, c(f"run_config.{n}")).alias(n) for n in names], *LANE_FACTS))
    both = None
    for on in (False, True):
        mine = lanes.where(c("grid_allowed") == on).drop("grid_allowed")
        m = metrics_of(lane_metrics(chunks, mine, KEYS, None, on), KEYS, grid_allowed=on)
        both = m if both is None else both.unionByName(m)
    info = cands.withColumn("bess_energy_mwh", c("bess_power_mw") * c("bess_duration_h"))
    rows = info.select(*KEYS, *CAND_COLS, "grid_size", "bess_energy_mwh", "scenario", "target_pct",
                       *econ_columns("econ")).join(both.hint("merge"), KEYS)
    sweep = sweep_rows(rows.withColumn("_t", c("target_pct")), ("scenario", "target_pct", "site_id"))
    return score_and_rank(sweep, c("target_pct"))
