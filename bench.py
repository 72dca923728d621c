"""Times the headline queries; one JSON line on standard output."""

import json
import os
import time

from pyspark.sql import SparkSession

from routeloom import catalogue

QUERIES = ("register_verdict", "trigram_pairs", "places_within", "duplicate_pairs", "parse_components", "upsert_keep_manual", "candidate_best", "suggest_rank", "two_opt", "batch_fixed", "route_links", "ocr_lines", "grid_islands", "call_latency")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in QUERIES:
        begun = time.time()
        catalogue.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begun, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
