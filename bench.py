"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores and ``BENCH_QUERIES`` a
comma-separated choice (``all`` for every query). Each query runs once to warm up on the
same data and is then timed ``BENCH_RUNS`` times; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from answerframe.plans.table_queries import QUERIES  # noqa: E402
from answerframe.session import local_session  # noqa: E402

HEADLINE = [
    "score_missing_wrong",
    "score_answered_only",
    "macro_score",
    "per_file_score",
    "run_report",
    "profile_datasets",
    "with_position",
    "stratified_split",
    "story_split",
    "best_epoch",
    "latest_success",
    "pending_resume",
    "validate_labels",
    "validate_answer",
    "parse_replies",
    "build_requests",
    "redact_text",
    "normalize_story",
    "decode_score",
    "multitask_loss",
    "flatten",
    "export_fresh",
    "relation_symmetry",
    "relation_reach",
    "answer_from_facts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        best = None
        for turn in range(runs + 1):
            start = time.perf_counter()
            # The noop sink runs the whole plan and every output column, with no rows brought to the driver.
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if turn:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
