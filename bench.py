"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from granary.plans import catalogue

HEADLINES = (
    "content_hash exact_duplicates near_duplicate_pairs duplicate_clusters group_split record_checks rule_router_predictions issue_metrics "
    "per_category_f1 calibration_ece coverage_at_error metric_slices bootstrap_ci vector_topk retrieval_metrics threshold_search "
    "citation_grounding chunk_documents kb_sync_plan stats_window idempotent_ingest stream_stats"
).split()


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.queries()["rule_router_accuracy"](spark, sf).collect()  # starts the JVM's code paths
    took = {}
    for name in HEADLINES:
        began = time.time()
        catalogue.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "median": round(statistics.median(took.values()), 3)}))


if __name__ == "__main__":
    main()
