"""Time the headline queries: one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run once to completion (noop sink, all columns) after a small warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["section_churn", "change_ids", "word_delta_multiset", "candidate_pairs", "greedy_match", "paragraphs",
            "exact_matches_across_years", "yoy_deltas", "metric_series", "metric_change_signal", "statement_table",
            "vector_topk", "rerank_topk", "retrieval_metrics", "span_overlap", "config_results", "failure_matrix",
            "threshold_grid", "stratified_sample", "evidence_pool", "extract_text", "extract_segments", "chunk_fixed",
            "chunk_sectionaware", "new_docs", "answer_numbers"]


def main() -> None:
    from redline import catalogue
    from redline.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.load_all()
    names = sys.argv[1:] or [n for n in HEADLINE if n in catalogue.QUERIES]
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
