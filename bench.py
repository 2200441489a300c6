"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query runs once to warm up and then REPEAT times; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queuesight import catalog  # noqa: E402
from queuesight.session import build_session  # noqa: E402

HEADLINE = [
    "coverage_by_threshold",
    "risk_gated_sweep",
    "classification_report",
    "confusion_matrix",
    "reliability",
    "per_class_calibration",
    "headline",
    "accuracy_at_budget",
    "latency_percentiles",
    "summarize_systems",
    "mcnemar",
    "bootstrap_ci",
    "curate_tickets",
    "dedupe_first",
    "profile_dataset",
    "token_length_stats",
    "fixed_splits",
    "stratified_sample",
    "risk_labels",
    "route_ticket",
    "likely_reason",
    "dashboard_summary",
    "load_new_tickets",
    "ticket_upsert",
    "top_k_probabilities",
    "score_external",
    "route_stream",
    "ingest_stream",
]
REPEAT = 2


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        best = float("inf")
        for run in range(REPEAT + 1):
            started = time.perf_counter()
            queries[name](spark, data).write.format("noop").mode("overwrite").save()
            if run:
                best = min(best, time.perf_counter() - started)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    scale = data.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
