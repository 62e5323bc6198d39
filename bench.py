"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tideline.plans import catalogue

HEADLINE = ("l01_line_consensus", "m01_offerings", "m03_best_price", "m06_market_row_gated", "d04_duplicate_collapse", "h04_closing_point", "h08_real_line_windows", "w01_latest_version", "j03_three_way_join", "j08_as_of", "s11_versioned_upsert", "t01_line_presence", "l07_movement", "i01_event_reconciliation", "e11_classification")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, took = catalogue.queries(), {}
    for name in HEADLINE:
        made[name](spark, folder).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        made[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
