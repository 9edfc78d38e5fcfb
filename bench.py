"""Time the headline queries on one machine and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list), BENCH_SMALL_DIR
(default /root/testdata/sf0.01, for the growth factors).
Each query is planned and run to the end with the rows discarded; the first run of a query that reads every
table warms the session up and is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from framewise.catalog import QUERIES
from framewise.session import local_session

HEADLINE = [
    "group_stats_sum",
    "group_stats_median",
    "group_share",
    "filter_stats",
    "crosstab_sum",
    "pie_other",
    "histogram",
    "describe",
    "boxplot",
    "iqr_outliers",
    "duplicates",
    "corr_pairs",
    "target_corr",
    "compare_segments",
    "compare_windows",
    "merge_inner",
    "merge_outer",
    "join_key_suggestions",
    "column_stats_lineitem",
    "full_profile",
    "insights",
    "readiness",
    "cap_outliers",
    "fill_median",
    "label_encode_many",
    "suggest_features",
    "mi_importance",
    "top_n_orders",
    "rolling_avg",
    "timeseries",
    "forecast_daily",
    "drift",
    "feedback_accuracy",
    "health",
    "alerts",
    "segment_perf",
    "residuals",
    "train_linear",
    "score",
    "kmeans",
    "anomalies",
    "scenarios",
    "cv",
    "pred_hist",
]


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    for name in ("group_stats_sum", "merge_inner"):
        run(QUERIES[name], spark, folder)
    times = {}
    for name in names:
        times[name] = round(run(QUERIES[name], spark, folder), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    # How much longer the query takes on the larger tables: below their ratio (10) fixed cost still counts.
    small = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    growth = {}
    if os.path.isdir(small) and small != folder:
        growth = {name: round(times[name] / max(run(QUERIES[name], spark, small), 1e-3), 2) for name in names}
    match = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "growth": growth,
                "sf": float(match.group(1)) if match else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
