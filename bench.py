"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tallyfield import registry

NAMES = ["match_events", "enriched_events", "outcome_totals", "progressions", "ledger", "claims", "asof_calls", "team_chains", "style_distances", "team_values"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["outcome_totals"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in NAMES:
        began = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
