"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query runs to
completion with all its columns into Spark's no-op sink; the time is the best of two runs after a
session warm-up. Names on the command line replace the headline list, "all" means every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from callsift.session import build_session, ensure_shared_dir
from checks.queries import QUERIES

HEADLINE = (
    "scan_call_details", "scan_transcripts", "sink_insert_ignore", "sink_upsert", "rubric_changes",
    "normalize_text", "transcript_features", "call_detail_lookup", "critical_risk_flag",
    "join_calls_summary", "join_training_set", "join_scores_calls", "unscored_calls",
    "missing_transcripts", "agent_rollup", "criteria_pass_rate", "agent_criteria_heatmap",
    "agents_dimension", "overview_kpis", "agent_avg_quality", "overall_call_score",
    "failed_criteria_list", "quality_log", "daily_score_trend", "agent_leaderboard",
    "rolling_7d_score", "first_match_dedupe", "parse_score_responses", "parse_summary_responses",
    "parse_ai_summary", "assemble_model_input", "model_inference_batch", "keyword_rubric_score",
    "sentiment_label", "chunk_documents", "vector_topk", "document_topk", "tfidf_search",
    "child_to_parent", "stream_daily_metrics", "predict_issue", "predict_resolution",
)
RUNS = 2


def timed(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    asked = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if list(asked) == ["all"] else list(asked)
    settings = {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g"}
    spark = ensure_shared_dir(build_session("bench", f"local[{cpus}]", **settings))
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, folder, "overview_kpis")
    seconds = {
        name: round(min(timed(spark, folder, name) for _ in range(RUNS)), 3) for name in names
    }
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
        "master": f"local[{cpus}]", "shuffle_partitions": cpus, "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
