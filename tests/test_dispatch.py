"""Dispatch, audit and metric behaviour on small fixed series (brute-force checks)."""


import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.config import with_config
from wattline.operators.audit import dispatch_audit, gas_reasons, objective_scorecard
from wattline.operators.dispatch import scheduled_dispatch, serve_first_dispatch
from wattline.operators.metrics import run_metrics
from wattline.plans.catalog import REASON_CFG
from wattline.sources.schedule import default_schedule_wide, schedule_long

BASE_A = dict(base_load_mw=100.0, load_type="24-7", battery_power_mw=50.0, battery_duration_h=2.0, rte=0.86,
              poi_limit_mw=200.0)
BASE_B = dict(base_load_mw=100.0, load_type="24-7", battery_power_mw=20.0, battery_duration_h=2.0, rte=0.86,
              poi_limit_mw=200.0, gas_enabled=True, gas_dispatchable=True, gas_pmax_mw=40.0, gas_pmin_mw=0.0,
              gas_cost_mode="simple", gas_var_cost_usd_per_mwh=30.0)


def series_a(spark, n=24, natgas=70.0):
    """Series A: wind 20->60, solar max(0, 80 sin x) for x in -1.5..1.5, gas 70, load 120, price 30->90."""
    ts = pd.date_range("2015-05-01", periods=n, freq="h")
    pdf = pd.DataFrame({"site_id": 1, "ts": ts, "wind_mw": np.linspace(20, 60, n),
                        "solar_mw": np.maximum(0, 80 * np.sin(np.linspace(-1.5, 1.5, n))),
                        "natgas_mw": natgas, "load_mw": 120.0, "price": np.linspace(30, 90, n)})
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def series_b(spark, n=24):
    """Series B: no renewables, gas column 40, load 100, price 50."""
    ts = pd.date_range("2015-05-01", periods=n, freq="h")
    pdf = pd.DataFrame({"site_id": 1, "ts": ts, "wind_mw": 0.0, "solar_mw": 0.0, "natgas_mw": 40.0,
                        "load_mw": 100.0, "price": 50.0})
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def metrics(spark, df, cfg, **kw):
    d = serve_first_dispatch(df, keys=["site_id"], cfg=cfg, **kw)
    return d, run_metrics(d, keys=["site_id"], grid_allowed=kw.get("grid_on", False), nested=True).first()


def test_zero_gas_column_does_not_disable_dispatchable_gas(spark):
    cfg = dict(BASE_A, gas_enabled=True, gas_dispatchable=True, gas_pmax_mw=50.0, gas_var_cost_usd_per_mwh=5.0)
    d, m = metrics(spark, series_a(spark, natgas=0.0), cfg)
    assert d.agg(F.sum("gas_gen")).first()[0] > 0 and m.total_natgas_mwh > 0


def test_profile_cap_opted_in_with_zero_column_gives_no_gas(spark):
    cfg = dict(BASE_A, gas_enabled=True, gas_dispatchable=True, gas_pmax_mw=50.0, gas_use_profile_as_cap=True)
    d, _ = metrics(spark, series_a(spark, natgas=0.0), cfg)
    assert d.agg(F.sum("gas_gen")).first()[0] == 0.0


def test_simple_and_advanced_cost_match(spark):
    base = dict(BASE_A, gas_enabled=True, gas_dispatchable=True, gas_pmax_mw=70.0, gas_pmin_mw=10.0)
    _, ms = metrics(spark, series_a(spark), dict(base, gas_cost_mode="simple", gas_var_cost_usd_per_mwh=28.0),
                    grid_on=True)
    _, ma = metrics(spark, series_a(spark), dict(base, gas_cost_mode="advanced", gas_heat_rate_mmbtu_per_mwh=7.0,
                                                 gas_fuel_price_usd_per_mmbtu=4.0, gas_vom_usd_per_mwh=0.0),
                    grid_on=True)
    assert ms.natgas_total_cost_usd == pytest.approx(ma.natgas_total_cost_usd, abs=1e-4)


def test_legacy_path_matches_when_gas_not_dispatchable(spark):
    _, m1 = metrics(spark, series_a(spark), dict(BASE_A, gas_enabled=False))
    _, m2 = metrics(spark, series_a(spark), dict(BASE_A, gas_enabled=True, gas_dispatchable=False))
    assert (m1.firmness_pct, m1.total_served_mwh, m1.total_gen_mwh) == (m2.firmness_pct, m2.total_served_mwh,
                                                                       m2.total_gen_mwh)


def test_higher_voll_never_more_unserved(spark):
    _, low = metrics(spark, series_b(spark), dict(BASE_B, voll_usd_per_mwh=10.0))
    _, high = metrics(spark, series_b(spark), dict(BASE_B, voll_usd_per_mwh=10_000.0))
    assert high.unserved_energy_mwh <= low.unserved_energy_mwh + 1e-6
    assert high.unserved_energy_mwh < low.unserved_energy_mwh      # gas is skipped below its cost


def test_ramp_limits_respected(spark):
    cfg = dict(BASE_A, gas_enabled=True, gas_dispatchable=True, gas_pmax_mw=100.0, gas_pmin_mw=0.0,
               gas_ramp_up_mw_per_h=5.0, gas_ramp_down_mw_per_h=5.0)
    d = serve_first_dispatch(series_a(spark, 12), keys=["site_id"], cfg=cfg, gas_follow_ramp=True)
    g = [r.gas_gen for r in d.orderBy("ts").select("gas_gen").collect()]
    assert all(abs(b - a) <= 5.0001 for a, b in zip(g, g[1:]))


def test_metric_contract(spark):
    _, m = metrics(spark, series_b(spark), dict(BASE_B, voll_usd_per_mwh=1000.0))
    for k in ("total_operating_cost_usd", "unserved_energy_mwh", "co2_tons", "horizon_hours", "firmness_pct",
              "renewable_gen_over_load_pct", "total_gen_over_load_pct"):
        assert k in m.asDict()
    assert set(m.cost_breakdown.asDict()) == {"unserved_voll", "gas_variable", "gas_no_load", "gas_startup",
                                              "bess_degradation", "carbon"}
    assert m.horizon_hours == 24.0 and m.sanity_check_passed


def test_serve_first_dispatch_passes_audit(spark):
    cfg = dict(BASE_A, gas_enabled=True, gas_dispatchable=True, gas_pmax_mw=30.0, gas_pmin_mw=5.0,
               battery2_power_mw=10.0, battery2_duration_h=2.0)
    d = serve_first_dispatch(series_a(spark, 48), keys=["site_id"], cfg=cfg, two_battery=True)
    bad = {r.rule: r.violations for r in dispatch_audit(d, keys=["site_id"]).collect()}
    assert all(v == 0 for v in bad.values()), bad


def test_state_of_charge_matches_plain_loop(spark):
    cfg = dict(BASE_A)
    rows = serve_first_dispatch(series_a(spark, 48), keys=["site_id"], cfg=cfg).orderBy("ts").collect()
    src = series_a(spark, 48).orderBy("ts").collect()
    e, s = 100.0, 0.0
    for r, x in zip(rows, src):
        net = x.wind_mw + x.solar_mw + x.natgas_mw - x.load_mw
        a = 0.86 * min(50.0, net) if net >= 0 else -min(50.0, -net)
        s = min(e, max(0.0, s + a))
        assert math.isclose(r.soc1, s, abs_tol=1e-9)


def test_scheduled_dispatch_follows_template(spark):
    cfg = dict(BASE_A)
    d = scheduled_dispatch(series_a(spark, 24), schedule_long(default_schedule_wide(spark)), keys=["site_id"],
                           cfg=cfg).orderBy("ts").collect()
    for r in d:
        h = r.ts.hour
        if r.schedule_action == "C":
            assert 9 <= h <= 13 and r.discharge == 0
        elif r.schedule_action == "D":
            assert 16 <= h <= 20 and r.charge == 0
        else:
            assert r.charge == 0 and r.discharge == 0
        assert -1e-9 <= r.soc <= 100.0 + 1e-9


def test_objective_scorecard_modes(spark):
    d = serve_first_dispatch(series_b(spark), keys=["site_id"], cfg=dict(BASE_B))
    sc = {r.mode: r.value for r in objective_scorecard(d, keys=["site_id"]).collect()}
    assert set(sc) == {"blend", "resilience", "revenue", "resilience_first_blend", "grid_on_max_revenue",
                       "cost_min_gridoff"}
    assert sc["revenue"] == sc["grid_on_max_revenue"]


def test_chunked_series_match_plain_windows(spark):
    from pyspark.sql import Window
    from wattline.operators.series import running_sums, with_preceding
    df = spark.range(0, 700).select((F.col("id") % 3).alias("k"), (F.col("id") * F.col("id") % 1999).alias("p"), "id",
                                    (F.col("id") * 7 % 11).cast("double").alias("x"))
    w = Window.partitionBy("k").orderBy("p", "id")
    ref = df.withColumns({"cum": F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                          "prev": F.lag("x").over(w)})
    got = running_sums(df, ["k"], "p", {"cum": "x"}, ["id"], span=16)
    assert sorted((r.id, r.cum) for r in got.collect()) == sorted((r.id, r.cum) for r in ref.collect())
    blocks = with_preceding(df, ["k"], F.col("p") * 100, ["p", "id"], 3, ["x"])  # about 20 rows a chunk
    for r in blocks.collect():
        assert len(r._tail) <= 3
    z = blocks.select("k", F.inline(F.arrays_zip(F.col("_rows").alias("r"), F.slice(F.concat(
        F.when(F.size("_tail") > 0, F.slice(F.transform("_tail", lambda t: t["x"]), -1, 1)).otherwise(
            F.array(F.lit(None).cast("double"))), F.transform("_rows", lambda t: t["x"])), 1, F.size("_rows")).alias("prev"))))
    assert sorted((r.id, r.prev is None, r.prev or 0.0) for r in z.select("r.id", "prev").collect()) == sorted(
        (r.id, r.prev is None, r.prev or 0.0) for r in ref.collect())


def test_lanes_equal_single_runs(spark):
    """A sweep's lanes give the same dispatch as one run per candidate."""
    from wattline.operators.lanes import lane_dispatch, lane_metrics, stored_chunks
    from wattline.operators.metrics import metrics_of, run_metrics
    df = series_a(spark, 96)
    sizes = [(0, 10.0, 2.0, 0.5), (1, 40.0, 4.0, 2.0)]
    lanes = spark.createDataFrame([(1, i, p, h, k) for i, p, h, k in sizes],
                                  "site_id long, candidate_id long, battery_power_mw double, battery_duration_h double, _sk double")
    site = df.select("site_id").first()[0]
    lanes = lanes.withColumns({"site_id": F.lit(site), "_wk": F.lit(None).cast("double"), "_load": F.lit(None).cast("double"),
                               "_ng_zero": F.lit(False)})
    cfg = dict(BASE_A, gas_enabled=True, gas_dispatchable=True, gas_pmax_mw=30.0, gas_pmin_mw=5.0, gas_startup_cost_usd=10.0,
               _varying=("battery_power_mw", "battery_duration_h"))
    for grid_on in (False, True):
        chunks = stored_chunks(df)
        rows = lane_dispatch(chunks, lanes, cfg=cfg, grid_on=grid_on)
        got = {(r.candidate_id, r.ts): r for r in rows.collect()}
        sums = metrics_of(lane_metrics(chunks, lanes, cfg=cfg, grid_on=grid_on), grid_allowed=grid_on)
        plain = run_metrics(rows, grid_allowed=grid_on)
        assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, plain.select(*sums.columns).collect()))
        for i, p, h, k in sizes:
            one = dict({x: v for x, v in cfg.items() if x != "_varying"}, battery_power_mw=p, battery_duration_h=h)
            run = serve_first_dispatch(df.withColumn("solar_mw", F.col("solar_mw") * k), keys=["site_id"], cfg=one, grid_on=grid_on)
            for r in run.collect():
                g = got[(i, r.ts)]
                for c in ("soc1", "charge", "discharge", "gas_gen", "serve", "clipped", "gas_cost", "gas_start", "gas_stop"):
                    assert getattr(g, c) == getattr(r, c), (grid_on, i, r.ts, c)


def test_gas_reasons_take_the_gas_column_from_the_metrics_pass(spark):
    cfg = dict(REASON_CFG)
    d = serve_first_dispatch(series_a(spark, 48), keys=["site_id"], cfg=cfg)
    gas = F.greatest(F.lit(0.0), F.coalesce(F.col("natgas_mw"), F.lit(0.0)))
    both = with_config(run_metrics(d, keys=["site_id"], also={"gas_column_sum": gas}), cfg)
    apart = gas_reasons(both.drop("gas_column_sum"), d.groupBy("site_id").agg(F.sum(gas).alias("gas_column_sum")), ["site_id"])
    assert gas_reasons(both, keys=["site_id"]).collect() == apart.collect()
