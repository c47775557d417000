"""Run the headline queries and print one JSON line with seconds per query."""
from __future__ import annotations

import json
import os
import time

from shirube import workload
from shirube.session import local_session

HEADLINE = [
    "review_queue", "approved_only_diffs", "master_diffs", "adoption_decisions", "confirm_batch", "latest_by_source", "match_two_of_three",
    "match_cascade", "cancel_join", "exact_shares", "integrate_outer", "segment_records", "quote_check", "locate_quotes", "page_correction",
    "single_hit_extract", "grant_interval_join", "cost_totals", "contract_cells", "group_hash", "reused_vs_new", "ledger_fold",
    "approve_report", "adopt_rules", "adopt_pointer", "register_batch", "ownership_splits", "grants_once", "renested", "stripped", "path_get", "closed_bundles",
    "legacy_columns", "sanity_checks", "ruled_ledger", "zoning_pages", "rules_topics", "label_lines", "lease_terms", "report_checks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, memory="16g", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = workload.all_queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("job_state")  # start-up is not part of any query
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
