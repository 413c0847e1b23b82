"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or 'all').
Each query is executed in full (every output column) without being collected, twice: the second run is reported, so
that code generation and the start of the JVM's paths are not what is measured.
"""

from __future__ import annotations

import json
import os
import time

from tidelog.plans import catalog
from tidelog.session import local_session

HEADLINE = [
    "count_by_level",
    "validate_entry",
    "log_hash",
    "dedup_first_wins",
    "dedup_vs_store",
    "merge_stats",
    "statistics",
    "statistics_grouping_sets",
    "retrieve",
    "newest_first_topk",
    "top_services",
    "explode_lines",
    "line_number",
    "chunk_budget",
    "chunk_next_fit",
    "chunk_next_fit_long_files",
    "chunk_payload",
    "normalize_timestamp",
    "parse_text_line",
    "clean_log_lines",
    "validate_entry_json",
    "store_append",
    "stream_merge",
    "scan_lines",
    "detect_format",
    "read_whole_file",
    "chunk_by_type",
    "stream_clean_merge",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = catalog.queries()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "tidelog-bench")
    # Start the JVM's I/O, shuffle and code generation paths before the clock runs.
    events = spark.read.parquet(f"{directory}/events.parquet")
    events.groupBy("event_type").count().orderBy("count").write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, directory).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
