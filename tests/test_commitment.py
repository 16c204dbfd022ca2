import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wattline.operators import commitment as op
from wattline.plans.catalog import REGISTRY


def plain(want, up, down):
    """Status by a loop: on until ``up`` has passed, off until ``down`` has."""
    out, on, held = [], False, 10 ** 9
    for w in want:
        if on:
            on, held = (True, held + 1) if w or held < up else (False, 1)
        else:
            on, held = (True, 1) if w and held >= down else (False, held + 1)
        out.append(float(on))
    return out


@pytest.mark.parametrize("span,fan", [(3, 2), (7, 3), (2048, 2048)])
def test_commit_equals_loop(spark, span, fan):
    rng = random.Random(span)
    keys = {k: (rng.choice([0, 1, 2, 5, 30]), rng.choice([0, 1, 3, 40]), rng.random()) for k in range(12)}
    rows = [(k, t, bool(rng.random() < p) if rng.random() < 0.95 else None, u, d)
            for k, (u, d, p) in keys.items() for t in range(rng.choice([1, 50, 170])) if t % 11 != 4]
    df = spark.createDataFrame(rows, "k int, t int, w boolean, u int, d int").repartition(5)
    out = op.commit(df, ["k"], F.col("t"), ["t"], F.col("w"), F.col("u"), F.col("d"), "on", "before", span, fan)
    got = {}
    for r in out.orderBy("k", "t").collect():
        got.setdefault(r.k, []).append((r.on, r.before, r.w))
    for k, rs in got.items():
        want = plain([bool(r[2]) for r in rs], max(keys[k][0], 1), max(keys[k][1], 1))
        assert [r[0] for r in rs] == want
        assert [r[1] for r in rs] == [0.0, *want[:-1]]


def test_maps_compose():
    rng = np.random.default_rng(2)
    up, down = 4, 3
    states = np.array([s for s in range(-down, up + 1) if s])
    whole = states
    for _ in range(40):
        w = rng.random() < 0.5
        one = lambda s: op.advance(s, np.full(len(s), w), np.full(len(s), up), np.full(len(s), down))
        table = one(states)
        assert (op.apply(down, table, whole) == one(whole)).all()
        whole = one(whole)


def test_committed_dispatch_has_no_violations(spark):
    out = {(r.site_id, r.rule): r.violations for r in REGISTRY["commitment_audit"][0](spark, SF_SMALL).collect()}
    kept = {"min_up", "min_down", "gas_bounds", "power_balance", "soc_step", "soc_bounds", "served_plus_unserved"}
    assert out and all(v == 0 for (_, rule), v in out.items() if rule in kept)
    free = {(r.site_id, r.rule): r.violations for r in REGISTRY["dispatch_audit"][0](spark, SF_SMALL).collect()}
    assert any(v > 0 for (_, rule), v in free.items() if rule in ("min_up", "min_down"))
