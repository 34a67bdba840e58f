"""Headline queries at one scale factor; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from changeloom.plans import catalogue

HEADLINE = (
    "churn_by_layer", "parse_lines", "file_churn", "triage", "heuristic_flags", "plan_cohorts",
    "input_bytes", "added_runs", "pair_changed_lines", "changed_spans", "identifier_tokens",
    "html_refs", "build_edges", "stable_order", "cohort_deps", "pack_batches", "prompt_batch",
    "repair_responses", "validate_membership", "blame_hunks", "cache_table", "snapshot_status",
    "doc_sink",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("changeloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
