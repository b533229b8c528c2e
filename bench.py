"""Headline timings on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["q_dedup", "q_conflicts", "q_prioritized", "q_cuda_range", "q_cuda_multi", "q_issues_by_severity",
            "q_analysis_summary", "q_parse_requirements", "q_readme", "q_ci", "q_pip_logs", "q_response_json",
            "q_repo_features", "q_training_records", "q_quality_issues", "q_quality_report", "q_strategy_patterns",
            "q_frequent_items", "q_similar_cases", "q_recommend", "q_ewma", "q_failures", "q_running",
            "q_cache_stats", "q_trends", "q_render", "q_validation_plan", "q_stream_success"]


def main() -> None:
    os.environ.setdefault("STACKLENS_DRIVER_MEMORY", "16g")
    from stacklens.plans import all_queries
    from stacklens.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "stacklens-bench")
    spark.conf.set("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    names = [n for n in sys.argv[1:] if n in queries] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        # the noop sink runs the whole plan without moving rows to the driver
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "dependency_rows": rows,
                      "rows_per_sec_dedup": round(rows / times["q_dedup"]) if "q_dedup" in times else None}))
    spark.stop()


if __name__ == "__main__":
    main()
