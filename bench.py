"""Time checked queries; prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  "headline" (default), "all", or names separated by commas
BENCH_RUNS     runs per query, the median counts (default 1, after one warm-up on a small query)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tabkit.plans import QUERIES
from tabkit.session import local_session

HEADLINE = [
    "value_counts", "infer_types", "profile", "profile_quantiles", "correlation_matrix", "inspect_overview", "inspect_numeric",
    "representative_flexible", "representative_by_source", "sample_rows", "encode_sentence", "encode_permuted", "encode_json",
    "draw_shots", "draw_shots_stratified", "build_prompts", "token_stats", "decode_sentence", "decode_json_array", "decode_json_lines",
    "repair_category", "cap_per_prompt", "roundtrip", "split_counts", "macro_f1", "compare_numeric", "histogram", "box_stats",
    "ks_statistic", "hellinger", "contingency_similarity", "referential_integrity", "dcr", "cap_disclosure",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "headline")
    names = HEADLINE if wanted == "headline" else list(QUERIES) if wanted == "all" else wanted.split(",")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tabkit-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["condition_flag"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name:30s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
