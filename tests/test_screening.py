"""Candidate grid, ranking, recommendation and economics (small fixtures + recorded values)."""

import pytest
from pyspark.sql import functions as F

from wattline.functions.econ import annual_figures, annualized_cost, with_econ
from wattline.plans import sweep as SW

UNIT_RANGES = {"solar": dict(mode="absolute", values=[0.0, 10.0]), "wind": dict(mode="absolute", values=[0.0]),
               "bess_power": dict(mode="absolute", values=[10.0, 20.0]),
               "bess_duration": dict(mode="absolute", values=[2.0]), "gas": dict(mode="absolute", values=[0.0, 40.0])}


def sites(spark, refs=((1, 100.0, 0.0),)):
    return spark.createDataFrame(list(refs), "site_id long, ref_solar_mw double, ref_wind_mw double")


def test_grid_size_is_the_product(spark):
    g = SW.candidate_grid(sites(spark), UNIT_RANGES)
    assert g.count() == 8 and g.select("grid_size").first()[0] == 8
    assert sorted(r.candidate_id for r in g.collect()) == list(range(8))


def test_site_over_the_cap_fails_alone(spark):
    big = {n: dict(mode="absolute", values=[float(v) for v in range(20)]) for n in SW.RANGE_NAMES}
    assert SW.candidate_grid(sites(spark), big, cap=1000).count() == 0
    r = SW.over_cap(sites(spark), big, 1000).first()
    assert r.site_id == 1 and not r.ok and "3200000" in r.error and "1000" in r.error


def test_failed_candidates_are_never_recommended(spark):
    rows = [(1, 0, False, 100.0, 10.0), (1, 1, True, 99.5, 500.0), (2, 0, False, 100.0, 10.0)]
    df = spark.createDataFrame(rows, "site_id long, candidate_id long, ok boolean, firmness_pct double, "
                                     "total_annual_cost_usd double")
    r = SW.score_and_rank(df, 99.0)
    assert {(x.site_id, x.candidate_id): x.rank for x in r.collect()} == {(1, 0): 2, (1, 1): 1, (2, 0): 1}
    rec = {x.site_id: x for x in SW.recommend(r, 99.0, df.select("site_id").distinct()).collect()}
    assert rec[1].candidate_id == 1 and rec[1].found and not rec[2].found and rec[2].candidate_id is None


def test_multipliers_use_site_reference(spark):
    rng = dict(UNIT_RANGES, solar=dict(mode="multipliers", values=[0.5, 1.0]))
    g = SW.candidate_grid(sites(spark, [(1, 100.0, 0.0), (2, 0.0, 0.0)]), rng)
    s1 = sorted({r.solar_mw for r in g.where("site_id = 1").collect()})
    s2 = sorted({r.solar_mw for r in g.where("site_id = 2").collect()})
    assert s1 == [50.0, 100.0] and s2 == [0.0]


def ranked(spark, rows, target):
    df = spark.createDataFrame([(1, i, True, f, c) for i, (f, c) in enumerate(rows)],
                               "site_id long, candidate_id long, ok boolean, firmness_pct double, "
                               "total_annual_cost_usd double")
    return SW.score_and_rank(df, target)


def test_score_and_rank_flags_and_recommendation(spark):
    r = ranked(spark, [(99.0, 1000.0), (100.0, 2000.0), (80.0, 500.0)], 99.0)
    flags = {x.firmness_pct: (x.meets_reliability, x.is_pareto) for x in r.collect()}
    assert flags[99.0][0] and not flags[80.0][0]
    assert flags[100.0][1] and flags[99.0][1] and flags[80.0][1]
    rec = SW.recommend(r, 99.0).first()
    assert rec.found and rec.meets_reliability and rec.total_annual_cost_usd == 1000.0
    assert rec.message == "target of 99.0 % met at least cost: 99.00 % of load served, $1,000 a year"


def test_recommendation_falls_back_to_most_reliable(spark):
    r = ranked(spark, [(80.0, 500.0), (90.0, 1500.0)], 99.0)
    rec = SW.recommend(r, 99.0).first()
    assert rec.found and not rec.meets_reliability and rec.firmness_pct == 90.0


def test_pareto_excludes_dominated_rows(spark):
    r = ranked(spark, [(95.0, 100.0), (90.0, 150.0), (85.0, 90.0)], 99.0)
    flags = {x.firmness_pct: x.is_pareto for x in r.collect()}
    assert flags == {95.0: True, 90.0: False, 85.0: True}


# --- fixed values: one recorded screening row (winner of the commercial scenario) ---
WINNER_SIZES = dict(solar_mw=80.0, wind_mw=0.0, bess_power_mw=40.0, bess_energy_mwh=160.0, gas_mw=25.0)
WINNER_RUN = dict(total_op_cost_usd_horizon=1123854.57, total_served_mwh=24244.76, horizon_hours=744.0)
WINNER_EXPECTED = dict(annualized_solar_usd=6446912.28, annualized_wind_usd=0.0, annualized_bess_power_usd=1317535.5,
                       annualized_bess_energy_usd=3513427.99, annualized_gas_usd=1716210.34,
                       fixed_om_total_usd_yr=2100000.0, annualized_total_usd_yr=15094086.11,
                       opex_usd_yr=13232481.23, total_annual_cost_usd=28326567.34, lcoe_usd_per_mwh=99.23)
# --- end fixed values ---------------------------------------------------------------


def test_economics_reproduce_recorded_winner(spark):
    df = spark.createDataFrame([{**WINNER_SIZES, **WINNER_RUN}])
    out = annual_figures(annualized_cost(with_econ(df))).first().asDict()
    for k, v in WINNER_EXPECTED.items():
        assert out[k] == pytest.approx(v, abs=0.011), k


def test_gas_sizing_recommendation(spark):
    df = spark.createDataFrame([(1, c, f, m) for c, f, m in
                                [(0.0, 70.0, 0.0), (25.0, 85.0, -100.0), (50.0, 92.0, -900.0), (75.0, 95.0, -950.0)]],
                               "site_id long, gas_capacity_mw double, firmness_pct double, "
                               "merchant_revenue_cost_usd double")
    df = df.withColumn("meets_target", F.col("firmness_pct") >= 90.0)
    r = {x.gas_capacity_mw: x for x in SW.recommend_gas_capacity(df, 90.0).collect()}
    assert r[50.0].is_recommended and not r[75.0].is_recommended
    assert r[50.0].is_knee and r[50.0].slope == pytest.approx(32.0)


def test_a_sweeps_plan_does_not_repeat_the_grid(spark):
    """Blocks of lanes and facts are tables, so the plan of a sweep stays small (it fills the driver otherwise)."""
    import datetime as dt
    from wattline.plans.catalog import SWEEP_BASE
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1.0, 5.0, 0.0, 9.0, 30.0) for s in (1, 2) for h in range(30)]
    iv = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, wind_mw double, solar_mw double, natgas_mw double, "
                                     "load_mw double, price double")
    sweep = SW.capacity_sweep(iv, SWEEP_BASE, UNIT_RANGES)
    plan = sweep._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") <= len(SW.CAND_COLS)
    assert sweep.count() == 16


def _small_sweep(spark):
    import datetime as dt
    from wattline.plans.catalog import SWEEP_BASE
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1.0, 5.0, 0.0, 9.0, 30.0) for s in (1, 2) for h in range(30)]
    iv = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, wind_mw double, solar_mw double, natgas_mw double, "
                                     "load_mw double, price double")
    return SW.capacity_sweep(iv, SWEEP_BASE, UNIT_RANGES)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_sent_to_the_driver(spark):
    """A grid is made from a small table of facts; a broadcast of it would gather all candidates in the driver."""
    sweep = _small_sweep(spark)
    ranked_rows = SW.score_and_rank(sweep, 60.0)
    assert "Broadcast" not in _plan(sweep) and "Broadcast" not in _plan(ranked_rows)
    assert sweep.count() == 16 and ranked_rows.count() == 16


def test_ranks_and_the_trade_offs_sweep_are_tables(spark):
    """What reads ranks twice, or the sweep, doesn't have all that made them in its plan."""
    sweep = _small_sweep(spark)
    ranked_rows = SW.score_and_rank(sweep, 60.0)
    both = SW.recommend(ranked_rows, 60.0).join(ranked_rows.groupBy("site_id").count(), "site_id")
    assert "Window" not in _plan(both)
    assert [(x.site_id, x["count"]) for x in both.orderBy("site_id").collect()] == [(1, 8), (2, 8)]
    slack = SW.slack_tradeoff(sweep)
    assert "ArrowEvalPython" not in _plan(slack)
    assert slack.count() == 2 * len(SW.DEFAULT_SLACKS)


def test_drilldown_stores_the_intervals_once(spark, monkeypatch):
    from tests.conftest import SF_SMALL
    from wattline.plans.catalog import REGISTRY
    made, chunks = [], SW.stored_chunks
    monkeypatch.setattr(SW, "stored_chunks", lambda *a: made.append(1) or chunks(*a))
    assert REGISTRY["drilldown"][0](spark, SF_SMALL).limit(1).count() == 1 and len(made) == 1
