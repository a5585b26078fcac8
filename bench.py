"""Time the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1).

Prints one JSON line: {"metric", "value" (sum of per-query medians plus the
one-off star build), "unit", "queries": {name: median seconds}, "sf", ...}.
``star_build`` is the load of the seven scorecard tables from the driver
tables (written as Parquet, as the scorecard's load step does; the cold first
build is reported separately); each query is planned and run to completion
(``write.format("noop")``) ``$BENCH_RUNS`` times after one warm-up.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpilane.plans.catalog import QUERIES, star  # noqa: E402
from kpilane.session import build_session, scratch_path  # noqa: E402
from kpilane.sources.adapter import star_from_tpch  # noqa: E402
from kpilane.sources.star import materialize_star  # noqa: E402

HEADLINE = [
    "employee_monthly_score",
    "employee_rank",
    "employee_scorecard_long",
    "branch_monthly_score",
    "branch_rank",
    "top3_advisors_latest_month",
    "leaderboard_employees",
    "province_performance",
    "measure_rollup",
    "referential_integrity",
    "reconcile_4dp",
    "target_plan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(f"local[{cpus}]", int(cpus), app_name="kpilane-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    timings = {}
    # the load step (driver tables -> star Parquet) that every query reads; timed
    # like the queries: one warm-up (which also fills the session's star), then
    # ``runs`` fresh builds into new folders
    t0 = time.perf_counter()
    star(spark, sf_dir)
    cold = time.perf_counter() - t0
    samples = []
    for _ in range(runs):
        t0 = time.perf_counter()
        folder = scratch_path(spark, "bench-star")
        materialize_star(spark, star_from_tpch(spark, sf_dir, stage_dir=f"{folder}/_stage"), folder)
        samples.append(time.perf_counter() - t0)
    timings["star_build"] = round(statistics.median(samples), 4)
    print(f"# star_build: {timings['star_build']}s (cold first build {cold:.2f}s)", file=sys.stderr)
    for name in names:
        fn = QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                samples.append(dt)
        timings[name] = round(statistics.median(samples), 4)
        print(f"# {name}: {timings[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "runs": runs,
        "spark": spark.version,
        "star_build_cold_sec": round(cold, 4),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
