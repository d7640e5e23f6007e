"""Run the headline queries once each, timed after a warm-up, and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citewell.plans import all_queries  # noqa: E402
from citewell.sources.tables import release_cuts  # noqa: E402

HEADLINE = [
    "I1_clean_html", "I4_assign_versions", "I5_merged_versions", "I9_hash_embedding", "I12_retry_decisions",
    "V3_score_and_gate", "S10_lexical_index", "F4_range", "F15_tenant_isolation", "D6_detect_pii", "D7_redact",
    "flagship_page_search", "R1_neural_search", "R1_vector_neighbours", "R2_bm25", "R3_reciprocal_rank_fusion",
    "R6_search", "R7_find_similar", "P11_chained_steps", "A1_contents", "A2_highlights", "A6_summary",
    "A10_detect_citations", "C3_robots_match", "C5_robots_as_of", "C6_fetch_gate", "C8_politeness", "M2_dedup_metering",
    "M3_token_bucket", "G6_latency_histogram", "G7_latency_percentiles", "G11_usage_by_window", "W8_sustained_condition",
    "N5_session_context", "J3_budget_stops", "J4_job_reports", "U3_remaining_audit", "U4_key_status", "join_inner",
    "ST4_token_bucket", "ST8_error_ratio_1h",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark, queries = session(), all_queries()
    # Start the JVM's compiler and the Python workers before the clock runs.
    for warm in ("I1_clean_html", "W3_previous_values", "join_inner"):
        queries[warm](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        release_cuts(spark)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": scale,
    }))


if __name__ == "__main__":
    main()
