"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of threads.  Each query runs
once to warm up and then ``BENCH_RUNS`` times into a sink that takes all rows and columns;
the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parley.plans.registry import QUERIES
from parley.session import build_session

HEADLINE = [
    "session_overview", "list_messages", "status_decision", "ingest_accepted", "ingest_sessions", "ingest_profiles",
    "check_constraints", "cascade_delete", "upsert_profiles", "apply_changes", "apply_changes_unmatched",
    "ingest_attachments", "attachment_status", "join_pages", "reference_block", "resolve_responses",
    "session_titles", "reply_blocks", "reply_bold", "inline_spans", "throttle_events", "throttle_events_12h",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "parley-bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
        },
    )
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, sum of medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
