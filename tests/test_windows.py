import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattline.operators.audit import gas_commitment
from wattline.operators.balance import chunked_rows
from wattline.operators.series import events, window_counts, window_starts


@pytest.mark.parametrize("span,bucket", [(5, 4), (16, 7), (3, 64)])
def test_counts_in_windows_of_any_length(spark, span, bucket):
    rng = random.Random(span)
    lengths = {1: (0, 3), 2: (1, 50), 3: (7, 1000), 4: (13, 2), 5: (200, 64)}
    rows = [(k, t * (9 if t > 60 else 1) + (t % 50 == 7), t, float(rng.random() < 0.3), float(rng.random() < 0.1), a, b)
            for k, (a, b) in lengths.items() for t in range(rng.choice([1, 120, 230]))]
    df = spark.createDataFrame(rows, "k int, p long, t int, up double, dn double, a int, b int").repartition(4)
    blocks = chunked_rows(df, ["k"], F.col("p"), F.struct("t", "up", "dn"), span, constant=["a", "b"]).withColumns(
        {"n": F.size("_rows").cast("long"), "starts": events("up"), "stops": events("dn")})
    w = window_starts(blocks, ["k"], {"starts": "a", "stops": "b"}, bucket)
    flags = lambda c: F.transform("_rows", lambda r: r[c])
    out = blocks.drop("starts", "stops").join(w, ["k", "_c"]).select("k", F.inline(F.arrays_zip(
        F.col("_rows").alias("r"), window_counts(flags("up"), F.col("starts")).alias("x"),
        window_counts(flags("dn"), F.col("stops")).alias("y")))).select("k", "r.t", "x", "y").collect()
    got = {(r.k, r.t): (r.x, r.y) for r in out}
    assert len(got) == len(rows)
    for k, (a, b) in lengths.items():
        mine = [r for r in rows if r[0] == k]
        for i, r in enumerate(mine):
            if a:
                assert got[k, r[2]][0] == sum(x[3] for x in mine[max(i - a + 1, 0):i + 1])
            if b:
                assert got[k, r[2]][1] == sum(x[4] for x in mine[max(i - b + 1, 0):i + 1])


def test_minimum_time_longer_than_a_chunk(spark):
    """5,000 hours with windows of 2,500 and 3,000 rows."""
    rng = random.Random(1)
    on, rows = 0.0, []
    for h in range(5000):
        before, on = on, float(rng.random() < (0.95 if on else 0.02))
        rows.append((1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), on * 5, on, float(on > before), float(on < before),
                     h / 10, 0.0, 1.0, 2500.0, 3000.0))
    names = "site_id ts gas_gen gas_on gas_start gas_stop soc1 soc2 dt_hours gas_min_up_h gas_min_down_h".split()
    kinds = ["long", "timestamp_ntz", *["double"] * 9]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    df = df.withColumns({c: F.lit(1.0) for c in ("poi_limit_mw", "rte", "battery2_rte", "gas_ramp_up_mw_per_h",
                                                  "gas_ramp_down_mw_per_h")} | {c: F.lit(True) for c in ("gas_enabled", "gas_dispatchable")})
    out = gas_commitment(df, ["site_id"]).orderBy("ts").collect()
    starts, stops = [r[4] for r in rows], [r[5] for r in rows]
    for i, r in enumerate(out):
        assert r.starts_in_min_up == sum(starts[max(i - 2499, 0):i + 1])
        assert r.stops_in_min_down == sum(stops[max(i - 2999, 0):i + 1])
        assert r.gas_prev == (rows[i - 1][2] if i else None) and r.soc1_prev == (rows[i - 1][6] if i else None)


def test_commitment_needs_few_columns(spark):
    """What is stored of a dispatch for ``gas_commitment`` is what it reads; the rows are the same."""
    from wattline.operators.audit import commitment_columns
    from wattline.operators.dispatch import serve_first_dispatch
    from wattline.plans.catalog import AUDIT_CFG
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(hours=h), 0.0, float(h * s % 7), 0.0, float(h % 5 * 9), 30.0) for s in (1, 2) for h in range(60)]
    iv = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, wind_mw double, solar_mw double, natgas_mw double, "
                                     "load_mw double, price double")
    disp = serve_first_dispatch(iv, keys=["site_id"], cfg=AUDIT_CFG)
    thin = commitment_columns(disp, ["site_id"])
    assert len(thin.columns) < len(disp.columns) / 2
    cols = ["site_id", "ts", "gas_gen", "gas_on", "gas_start", "gas_prev", "ramp_step", "starts_in_min_up", "stops_in_min_down"]
    both = [sorted(map(tuple, gas_commitment(d, keys=["site_id"]).select(*cols).collect())) for d in (disp, thin)]
    assert both[0] == both[1] and len(both[0]) == 120


@pytest.mark.parametrize("span", [4, 4096])
def test_sums_make_their_rows_once(spark, span):
    from wattline.operators.series import chunk_sums
    seen = spark.sparkContext.accumulator(0)

    def value(x):
        seen.add(1)
        return float(x * 7 % 11 - 4)

    df = spark.range(90, numPartitions=3).select(F.when(F.col("id") < 88, F.col("id") % 2).alias("k"), F.col("id").alias("t"),
                                                 F.udf(value, "double")("id").alias("v"))
    out = chunk_sums(df, ["k"], F.col("t"), ["t"], {"a": F.col("v"), "b": F.col("v") * 2}, span).collect()
    assert seen.value <= 90 and len(out) == 88  # rows without a key belong to no series
    for r in out:
        total = sum(i * 7 % 11 - 4 for i in range(r.k, r.t + 1, 2))
        assert (r.v, r.a, r.b) == (r.t * 7 % 11 - 4, total, total * 2)
