"""Headline queries on one folder of sample tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs to completion
twice (all rows produced, none fetched); the second, warm time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from answerscope.plans.catalog import load_all, runner
from answerscope.session import get_spark

HEADLINE = [
    "visibility_matrix", "heatmap", "volatility", "run_summary", "tag_summary", "citation_summary", "citation_score",
    "run_diff_citations", "domain_profile", "compare_brands", "sentiment_points", "tool_latency", "rank_anomalies", "citation_novelty",
    "extracted_mentions", "document_citations", "extracted_claims", "answer_text", "page_audit", "shingles", "similar_documents",
    "entities_to_merge", "access_log_hits", "crawler_events", "site_event_rollup_frozen", "consent_as_of",
    "recommendations_by_kind", "illegal_transitions", "measured_outcomes", "brand_cost_daily",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    catalog, times, cold = load_all(), {}, {}
    for name in names:
        for book in (cold, times):
            start = time.perf_counter()
            runner(catalog[name])(spark, folder).write.format("noop").mode("overwrite").save()
            book[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: cold {cold[name]} warm {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_total_warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
