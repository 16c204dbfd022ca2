import random

import pytest
from pyspark.sql import functions as F

from wattline.operators.balance import bounded_balance, next_chunks, opening_chunks
from wattline.operators.ramp import ramp_follow


def loop(rows, init=0.0):
    """Plain sequential balance: (before, after, before the previous) of (a, lo, hi) rows."""
    s, sp, out = init, None, []
    for a, lo, hi in rows:
        new = min(hi, max(lo, s + a))
        out.append((s, new, sp))
        s, sp = new, s
    return out


def _series(n_keys, n, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(n_keys):
        hi = rnd.choice([0.0, 5.0, 40.0, 1e6])
        p = 0
        for _ in range(n):
            p += rnd.choice([1, 1, 1, 2, 40])  # missing intervals
            rows.append((k, p, rnd.uniform(-30, 30), 0.0, hi))
    return rows


@pytest.mark.parametrize("span,fan", [(2048, 2048), (8, 4), (4, 3), (1, 2)])
def test_chunk_sizes_never_change_a_value(spark, span, fan):
    rows = _series(5, 150, 11)
    df = spark.createDataFrame(rows, "k long, p long, a double, lo double, hi double")
    out = bounded_balance(df, ["k"], "p", "a", "lo", "hi", prev2_out="soc_prev2", lagged={"a_prev": F.col("a")}, span=span,
                          fan=fan)
    got = {(r.k, r.p): r for r in out.collect()}
    assert len(got) == len(rows)
    for k in range(5):
        mine = [r for r in rows if r[0] == k]
        before = None
        for r, (s0, s, sp) in zip(mine, loop([r[2:] for r in mine])):
            g = got[(k, r[1])]
            assert g.soc == pytest.approx(s, abs=1e-6) and g.soc_prev == pytest.approx(s0, abs=1e-6)
            assert g.a_prev == before and (g.soc_prev2 is None) == (sp is None)
            assert sp is None or g.soc_prev2 == pytest.approx(sp, abs=1e-6)
            before = r[2]


def test_payload_kept(spark):
    df = spark.createDataFrame([(1, i, 10.0, 0.0, 15.0, f"x{i}") for i in range(5)],
                               "k long, p long, a double, lo double, hi double, tag string")
    out = bounded_balance(df, ["k"], "p", "a", "lo", "hi").orderBy("p")
    assert [r.tag for r in out.collect()] == [f"x{i}" for i in range(5)]
    assert [r.soc for r in out.collect()] == [10.0, 15.0, 15.0, 15.0, 15.0]


def test_equal_times_give_the_same_result_in_any_row_order(spark):
    rows = [(1, i // 4, float((i * 7) % 11 - 5)) for i in range(40)]
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k long, t long, a double").repartition(seed + 1)
        out = bounded_balance(df, ["k"], "t", "a", 0.0, 9.0, order=["t"], span=3)
        results.append(sorted((r.t, r.a, r.soc) for r in out.collect()))
    assert results[0] == results[1]


@pytest.mark.parametrize("span,fan", [(2048, 2048), (16, 3), (5, 2)])
def test_ramp_fold_equals_a_loop(spark, span, fan):
    rnd = random.Random(4)
    rows, want = [], {}
    for k in range(4):
        g = 0.0
        up, down = [(3.0, 2.0), (50.0, 50.0), (0.5, 0.25), (8.0, 1.0)][k]
        for p in range(120):
            t = rnd.choice([0.0, 0.0, rnd.uniform(0, 25.0)])
            before, g = g, min(g + up, max(g - down, t))
            rows.append((k, p, t, up, down))
            want[(k, p)] = (before, g)
    df = spark.createDataFrame(rows, "k long, p long, t double, u double, d double")
    out = ramp_follow(df, ["k"], F.col("p"), ["p"], F.col("t"), F.col("u"), F.col("d"), F.lit(25.0), "g", "g0",
                      {"t_prev": F.col("t")}, span=span, fan=fan)
    got = {(r.k, r.p): r for r in out.collect()}
    for key, (g0, g) in want.items():
        assert got[key].g == pytest.approx(g, abs=1e-9) and got[key].g0 == pytest.approx(g0, abs=1e-9)


def test_rows_are_dealt_once(spark, tmp_path):
    """The readers of the chunks ask for the same rows, so their exchange runs once."""
    spark.createDataFrame(_series(6, 300, 5), "k int, p long, a double, lo double, hi double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = bounded_balance(df, ["k"], "p", "a", "lo", "hi", span=16, fan=4)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1


def test_only_chunks_that_open_another_are_composed(spark):
    rows = [(1, p, 1.0) for p in range(5)] + [(2, p, 1.0) for p in (0, 9, 25, 26)] + [(None, 3, 1.0)]
    df = spark.createDataFrame(rows, "k long, p long, a double")
    row = F.struct("p", "a")
    nexts = next_chunks(df, ["k"], F.col("p"), row, 8)
    assert sorted(tuple(r) for r in nexts.collect()) == [(2, 0, 1, False), (2, 1, 3, True)]
    opening = opening_chunks(df, nexts, ["k"], F.col("p"), row, 8)
    assert sorted((r.k, r._c, len(r._rows)) for r in opening.collect()) == [(2, 0, 1), (2, 1, 1)]
    # keys of one chunk each: the rows go to Python once, to be folded
    out = bounded_balance(df, ["k"], "p", "a", 0.0, 3.0)
    assert sorted((r.k, r.p, r.soc) for r in out.collect()) == sorted(
        [(1, p, min(p + 1.0, 3.0)) for p in range(5)] + [(2, p, s) for p, s in zip((0, 9, 25, 26), (1.0, 2.0, 3.0, 3.0))])
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ArrowEvalPython") == 1
