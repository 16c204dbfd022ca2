import random

import pytest
from pyspark.sql import functions as F

from wattline.plans.sweep import score_and_rank


def plain(rows, target):
    """Rank and frontier of each site by sorting its whole grid."""
    out = {}
    for site in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == site]
        best = None
        for r in sorted((r for r in mine if r[2]), key=lambda r: (-r[3], r[4], r[1])):
            out[site, r[1]] = [best is None or r[4] < best - 1e-6, None]
            best = r[4] if best is None else min(best, r[4])
        meets = lambda r: r[2] and r[3] >= target
        key = lambda r: (not r[2], not meets(r), r[4] if meets(r) else 0.0, -r[3], r[4], r[1])
        for k, r in enumerate(sorted(mine, key=key)):
            out.setdefault((site, r[1]), [False, None])[1] = k + 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("shape", ["random", "ties", "all on the frontier"])
def test_rank_and_frontier_of_large_and_small_grids(spark, shape):
    rng = random.Random(len(shape))
    rows = []
    for site, n in {1: 6000, 2: 1, 3: 40, 4: 700}.items():
        for k in range(n):
            f = round(rng.uniform(50, 100), 2) if shape != "ties" else rng.choice([90.0, 95.0, 100.0])
            cost = f * 1000 + k % 3 * 1e-7 if shape == "all on the frontier" else float(rng.randint(1, 500) if shape == "ties" else rng.uniform(1, 1e6))
            rows.append((site, k, rng.random() > 0.05, f, cost))
    df = spark.createDataFrame(rows, "site_id long, candidate_id long, ok boolean, firmness_pct double, total_annual_cost_usd double")
    out = score_and_rank(df.repartition(7), 92.0)
    got = {(r.site_id, r.candidate_id): (r.is_pareto, r.rank) for r in out.collect()}
    assert got == plain(rows, 92.0)
    if shape == "random":  # a large site's grid lies in many ranges
        from wattline.operators.series import ranged
        assert ranged(df, ["site_id"], [F.col("firmness_pct")], "t").where("site_id = 1").select("_p").distinct().count() > 3


def test_sweep_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def cost(x):
        seen.add(1)
        return float(x % 17)

    n = 300
    sweep = spark.range(n, numPartitions=4).select(
        (F.col("id") % 3).alias("site_id"), F.col("id").alias("candidate_id"), F.lit(True).alias("ok"),
        (F.col("id") % 7).cast("double").alias("firmness_pct"), F.udf(cost, "double")("id").alias("total_annual_cost_usd"))
    rows = score_and_rank(sweep, 3.0).collect()
    assert len(rows) == n and seen.value == n
