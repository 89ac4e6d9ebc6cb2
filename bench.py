"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default: all)
    BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartwave.registry import registry  # noqa: E402
from cartwave.session import local_session  # noqa: E402

HEADLINE = [
    "agg1_user_monthly_action",
    "agg1_user_item_monthly_action",
    "agg3_user_diversity",
    "agg4_item_penetration",
    "agg8_item_over_users",
    "agg10_item_repeat",
    "agg11_user_item_repeat",
    "pro1_item_profile",
    "pro2_user_profile",
    "pro8_user_item_dataset",
    "pro9_buy_dataset",
    "pro11_user_brand_dataset",
    "smp1_undersample_negatives",
    "met3_fold_scores",
    "ml2_gaussian_nb",
    "geo2_grid_label",
    "jn6_station_lookup",
    "jn6_station_lookup_shuffled",
    "met10_station_median",
    "top5_error_curve",
    "ml17_lend_best_errors",
]


# the first run of a query compiles its code; the better of two is reported
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "cartwave-bench")
    queries = registry().queries
    # start the JVM's code paths before the clock runs
    queries["agg1_user_monthly_action"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
