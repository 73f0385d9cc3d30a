"""Times the headline queries; prints one JSON line. $BENCH_SF_DIR and $BENCH_CPUS choose input and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from rolescape.plans.catalog import QUERIES

HEADLINES = ("dedup_representatives", "dedup_variants", "summary_by_company", "daily_metrics", "top_100_jobs", "link_completeness", "fingerprint_sha256", "canonical_url", "match_score", "enrich_fill_empty", "contact_dedup", "country_coverage", "proof_coverage", "source_health_latest", "shortlist", "report_48h", "page_links", "ledger_merge")


def main() -> None:
    folder, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("bench").config("spark.sql.shuffle.partitions", cores).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["active_rows"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's compiled code
    seconds = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
