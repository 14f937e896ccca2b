"""Time the main queries. Prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8); BENCH_RUNS: runs per query,
of which the fastest counts (default 2).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "ingest_validate",
    "sessions",
    "daily_counts",
    "goal_action_counts",
    "window_counts",
    "merged_states",
    "predict",
    "action_scores",
    "policy_by_request",
    "sticky_decisions",
    "stream_daily_counts",
]


def main() -> None:
    from liftloom.plans.catalog import QUERIES
    from liftloom.session import build

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build("bench", cpus=cpus, memory="16g", shared=tempfile.mkdtemp(prefix="liftloom-bench-"))
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(runs):
            begin = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begin
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over the main queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
