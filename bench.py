"""Benchmark the headline queries.

Runs each query end to end at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints ONE JSON line::

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query is forced with a ``noop`` write, so all rows are computed but
nothing is collected to the driver.  One warm-up query runs first so JVM
start-up is not charged to the first headline query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattline.plans.catalog import REGISTRY  # noqa: E402
from wattline.session import checkpoint_dir, get_spark  # noqa: E402

HEADLINE = ["intervals_clean", "scheduled_metrics", "run_metrics", "dispatch_audit", "gas_sizing", "batch_grid",
            "capacity_sweep", "recommended"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(master=f"local[{cpus}]", app_name="wattline-bench")
    checkpoint_dir(spark)
    REGISTRY["intervals_clean"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for n in names:
        t0 = time.time()
        REGISTRY[n][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
