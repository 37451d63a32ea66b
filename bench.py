"""Benchmark the headline queries; prints ONE JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_RUNS`` (timed runs per query, default 3, after one
warm-up).  Each run executes the whole plan into Spark's ``noop`` sink, so
nothing is collected to the driver.  The value is the sum of the per-query
medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyspark.plans import QUERIES  # noqa: E402
from tallyspark.session import build_session  # noqa: E402

HEADLINE = [
    "restock_recommendations",
    "top_selling_products",
    "dashboard_metrics",
    "weekly_totals",
    "customer_balances",
    "total_unpaid_debt",
    "assistant_answers",
    "apply_sales",
    "apply_stock_timeline",
    "apply_payments",
    "upsert_customers",
]


def run_once(spark, key: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(master=f"local[{cpus}]", app_name="tallyspark-bench")
    times: dict[str, float] = {}
    for key in HEADLINE:
        run_once(spark, key, sf_dir)  # warm-up: JIT, file listing, Python workers
        times[key] = round(statistics.median(run_once(spark, key, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus) if cpus.isdigit() else cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
