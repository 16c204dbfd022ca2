import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from wattline.config import full_config
from wattline.operators import lanes as op
from wattline.operators.dispatch import serve_first_dispatch
from wattline.operators.metrics import metrics_of, run_metrics

CFG = dict(full_config(dict(base_load_mw=10.0, load_type="24-7", battery_power_mw=5.0, battery_duration_h=2.0, rte=0.85,
                            poi_limit_mw=12.0, gas_enabled=True, gas_dispatchable=True, gas_pmax_mw=6.0, gas_pmin_mw=2.0,
                            gas_startup_cost_usd=9.0, voll_usd_per_mwh=400.0, gas_var_cost_usd_per_mwh=30.0)),
           _varying=("battery_power_mw",))


def intervals(spark, sites):
    """Hourly rows; ``sites`` maps a site to its number of hours."""
    rng = random.Random(5)
    at = dt.datetime(2024, 1, 1)
    rows = [(s, at + dt.timedelta(hours=h), round(rng.uniform(0, 9), 2), round(max(rng.gauss(3, 4), 0.0), 2),
             round(rng.uniform(0, 3), 2), round(rng.uniform(2, 14), 2), round(rng.uniform(5, 60), 2))
            for s, n in sites.items() for h in range(n) if h % 97 != 13]
    return spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, wind_mw double, solar_mw double, natgas_mw double, load_mw double, price double")


def lanes(spark, sites, n):
    none = F.lit(None).cast("double")
    return spark.createDataFrame([(s,) for s in sites], "site_id long").crossJoin(
        spark.range(n).withColumnRenamed("id", "candidate_id")).withColumns({
            "battery_power_mw": F.col("candidate_id") / 50, "_sk": none, "_wk": F.lit(0.5), "_load": none, "_ng_zero": F.lit(False)})


@pytest.mark.parametrize("grid_on", [False, True])
def test_blocks_and_chunks_equal_single_runs(spark, grid_on):
    """Sites of several chunks, blocks of one, three and all lanes."""
    iv = intervals(spark, {1: 5000, 2: 40, 3: 2100})
    chunks = op.stored_chunks(iv)
    assert chunks.groupBy("site_id").count().where("site_id = 1").first()[1] > 2
    ls = lanes(spark, [1, 2, 3], 7)
    results = []
    for size in (8 * op.SPAN, 3 * 8 * op.SPAN, op.BLOCK_BYTES):
        m = metrics_of(op.lane_metrics(chunks, ls, cfg=CFG, grid_on=grid_on, block_bytes=size), grid_allowed=grid_on)
        results.append(sorted(map(tuple, m.collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == 21
    for power in (0, 6):
        one = dict({k: v for k, v in CFG.items() if k != "_varying"}, battery_power_mw=power / 50)
        run = serve_first_dispatch(iv.withColumn("wind_mw", F.col("wind_mw") * 0.5), keys=["site_id"], cfg=one, grid_on=grid_on)
        plain = run_metrics(run, ["site_id"], grid_allowed=grid_on).withColumn("candidate_id", F.lit(power))
        want = {r.site_id: r for r in plain.collect()}
        got = m.where(F.col("candidate_id") == power)
        for r in got.collect():
            for c in got.columns:
                if c != "candidate_id":
                    assert getattr(r, c) == getattr(want[r.site_id], c), (power, r.site_id, c)


def test_many_candidates_of_one_site_lie_in_blocks(spark):
    chunks = op.stored_chunks(intervals(spark, {1: 30, 2: 30}))
    ls = lanes(spark, [1], 20_000).unionByName(lanes(spark, [2], 3))
    dealt = op.lanes_of(chunks, ls, ["site_id", "candidate_id"], CFG)
    per_block = op.BLOCK_BYTES // (8 * op.SPAN)
    sizes = [r[0] for r in dealt.base.where("site_id = 1").select(F.size("_lanes")).collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 100 and max(sizes) < 2 * per_block
    m = metrics_of(op.lane_metrics(chunks, ls, cfg=CFG)).select("site_id", "candidate_id", "total_served_mwh", "cycles_battery1")
    assert m.count() == 20_003
    few = metrics_of(op.lane_metrics(chunks, ls.where("candidate_id % 1000 = 1"), cfg=CFG, most_lanes=20)).select(*m.columns)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, m.where("candidate_id % 1000 = 1").collect()))


def test_windows_prune_chunks(spark):
    iv = intervals(spark, {1: 9000, 2: 50, 3: 300}).withColumn(
        "load_mw", F.when(F.col("site_id") == 3, None).otherwise(F.col("load_mw")))
    conf = spark.createDataFrame([(1, "2024-04-01", "2024-05-10", "24-7", 7.0, 0.0), (2, "2024-06-01", "2024-06-02", "24-7", 7.0, 0.0),
                                  (3, "2024-01-02", "2024-01-02", "16-7", 7.0, 0.0)],
                                 "site_id long, start_date string, end_date string, load_type string, base_load_mw double, load_std double")
    conf = conf.select("site_id", F.struct(*conf.columns[1:]).alias("run_config"))
    chunks = op.stored_chunks(iv)
    cut = op.windowed_chunks(chunks, conf)
    rows = cut.select("site_id", F.inline("_rows")).collect()
    assert {r.site_id for r in rows} == {1, 3}  # nothing of site 2 lies in its window
    want = iv.where("site_id = 1 and ts >= timestamp_ntz'2024-04-01' and ts < timestamp_ntz'2024-05-11'").count()
    assert sum(r.site_id == 1 for r in rows) == want
    load = {r.ts.hour: r.load_mw for r in rows if r.site_id == 3}
    assert all(r.ts.date() == dt.date(2024, 1, 2) for r in rows if r.site_id == 3)
    assert load[6] == 0.0 and load[7] == 7.0 and load[22] == 7.0 and load[23] == 0.0


@pytest.mark.parametrize("fan", [2, 3])
def test_openings_of_a_block_in_groups(spark, monkeypatch, fan):
    """Chunks open alike however many of them a group takes; a block's lanes are one row of it."""
    monkeypatch.setattr(op, "SPAN", 64)
    chunks = op._stored(op.chunked_rows(intervals(spark, {1: 700, 2: 30}), ["site_id"], op.chunk_position(), F.struct(
        "ts", "wind_mw", "solar_mw", "natgas_mw", "load_mw", "price"), 64))
    ls = lanes(spark, [1, 2], 5)
    whole = sorted(map(tuple, op.lane_metrics(chunks, ls, cfg=CFG).collect()))
    monkeypatch.setattr(op, "FAN", fan)
    assert sorted(map(tuple, op.lane_metrics(chunks, ls, cfg=CFG).collect())) == whole and len(whole) == 10
    opened = op.lanes_of(chunks, ls, ["site_id", "candidate_id"], CFG).opened
    assert dict(opened.dtypes)["s_in"] == "array<double>" and opened.count() == chunks.count() > 10


def test_lanes_are_not_sent_to_the_driver_and_openings_are_a_table(spark):
    """Blocks of lanes are small as files and large in memory."""
    chunks = op.stored_chunks(intervals(spark, {1: 2500, 2: 40}))
    dealt = op.lanes_of(chunks, lanes(spark, (1, 2), 3), ["site_id", "candidate_id"], CFG, most_lanes=3)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(dealt.base) and "ArrowEvalPython" not in plan(dealt.opened)
    assert dealt.joined().count() == chunks.count()


def test_a_window_moves_no_rows(spark, monkeypatch):
    """Chunks cut to a window stay where they lie: their rows are in no exchange."""
    chunks = op.stored_chunks(intervals(spark, {1: 5000, 2: 40}))
    conf = spark.createDataFrame([(s, {"start_date": "2024-01-02", "end_date": "2024-02-02", "load_type": "24-7", "base_load_mw": 3.0,
                                       "load_std": 1.0}) for s in (1, 2)], "site_id long, run_config struct<start_date:string,"
                                 "end_date:string,load_type:string,base_load_mw:double,load_std:double>")
    monkeypatch.setattr(op, "_stored", lambda d: d)
    cut = op.windowed_chunks(chunks, conf)
    text = spark._jvm.PythonSQLUtils.explainString(cut._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", text)
    assert moved and not any("_rows" in x for x in moved)
    assert cut.count() == 2
