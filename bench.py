"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned from the registry and fully executed through the
``noop`` sink (no collect cost); one warm-up run, then the median of
$BENCH_RUNS timed runs.  Each query's time goes to stderr as it ends; a query stopped after
$BENCH_QUERY_SEC seconds counts as null.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlark.plans import REGISTRY  # noqa: E402
from ledgerlark.session import local_session  # noqa: E402

HEADLINE = [
    "kpi_summary", "daily_sales_filled", "top_revenue_products", "sales_report",
    "anomaly_summary", "pareto_abc", "brand_pareto_abc", "what_if_scenarios",
    "clean_sales", "cleaning_report", "date_order", "column_profile", "candidate_scores",
    "extra_column_profile", "weekly_feature_join", "weekly_history_features",
    "train_test_split", "forecast_summary", "brand_forecast_summary",
    "business_summary", "ridge_forecast", "model_comparison",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    spark.catalog.clearCache()  # no run reads what another has cached
    t0 = time.perf_counter()
    df = REGISTRY[name].fn(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2 if cpus.isdigit() else 16))
    limit = float(os.environ.get("BENCH_QUERY_SEC", "240"))  # for all runs of one query
    times: dict[str, float | None] = {}
    for name in names:
        stop = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
        stop.start()
        try:
            run_once(spark, name, sf_dir)  # warm-up (JIT, codegen, file listing)
            times[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
        except Exception as error:  # noqa: BLE001 - one query must not lose the others' numbers
            times[name] = None
            print(f"{name}: {type(error).__name__}", file=sys.stderr, flush=True)
        finally:
            stop.cancel()
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(t for t in times.values() if t is not None), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
