"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "deduplicated_page", "dedupe_fold", "upsert_two_batches", "insert_new_only", "replace_link_sets",
    "retention_cascade", "strip_html", "normalize_hash", "salary_parse", "contacts_in_documents",
    "sections_of_profiles", "years_of_experience", "dictionary_match", "first_page", "compound_filter",
    "linked_to_all", "search_page", "suggest_frequent", "boards_with_counts", "nearest_to_one",
    "nearest_for_all", "nearest_for_all_approximate", "hashed_encoding", "queue_stats", "span_union",
    "lockout", "rate_limit", "response_cache", "prompt_contexts", "usage_rollup", "scan_arbeitnow",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE

    import workload
    from rolemill.plans.session import build_session

    spark = build_session("bench", cores=cpus, shuffle_partitions=cpus,
                          shared_dir=tempfile.mkdtemp(prefix="rolemill-bench-"))
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {best:.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
