"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

import veil_queries as q

HEADLINE = (
    "scan_documents", "anonymize_documents", "anonymize_documents_email", "scan_conversations", "scan_pages",
    "scan_letters", "anonymize_all", "anonymize_hash", "analyze_letters", "dictionary_names",
    "analyze_with_dictionary", "eval_metrics", "confusion_long", "golden_report", "resolve_arrays", "resolve_rows",
    "ner_overlap_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.files.minPartitionNum", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    q.QUERIES["find_email"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
