"""Run the headline queries on the tables of $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from sieveline.plans import QUERIES
from sieveline.session import local_session

HEADLINES = (
    "pii_by_language", "detect_pii", "detect_card", "detect_secrets", "detect_high_entropy", "detect_cloud_secrets",
    "mask_pii_obfuscated", "classify_number_blocks", "redact_priority", "redact_all_types", "detect_plan", "join_text_rules",
    "first_hit_per_text", "mask_merged", "resolve_overlaps_longest", "mask_lines", "decide_code_risk", "run_filter_chain",
    "final_decision", "final_decision_table", "regex_policy_action", "effective_rules", "policy_diff", "merge_islands",
    "assign_uuid", "recent_history", "scan_conversations", "recover_verdict_json", "scan_files", "attach_output_to_prompt")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
