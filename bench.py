"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads, BENCH_QUERIES (comma
separated) replaces the list of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from headersieve.plans.queries import QUERIES  # noqa: E402
from headersieve.session import build_session  # noqa: E402

HEADLINES = (
    "shred_headers_json",
    "parse_log_lines",
    "parse_user_agents",
    "is_crawler",
    "family_counts",
    "header_pairs",
    "fit_value_vocabulary",
    "full_features",
    "score_families",
    "human_verdict",
    "request_verdict",
    "make_bot_sample",
    "error_rates",
    "newest_logs",
    "fit_label_codes",
    "ingest_pending",
    "stream_verdicts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = build_session(
        "headersieve-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    # Start the engine and load the signatures, as a long-running job would have.
    QUERIES["is_crawler"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    cold, seconds = {}, {}
    for name in names:
        # The first run compiles; the second is what a long-running job sees.
        for took in (cold, seconds):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    total = sum(seconds.values())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": seconds,
                "first_runs": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rows": events,
                "rows_per_sec": {n: round(events / s) for n, s in seconds.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
