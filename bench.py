"""Times the headline queries: python bench.py prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose input and cores."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tickweave.plans import catalog

HEADLINE = ["bars_gap_filled", "robust_z", "engine_tick_bars", "engine_ablation", "lead_lag_best", "alert_budget_sweep", "matched_recall", "bootstrap_ci", "greedy_days", "stream_bars"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    catalog.bars_hourly(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    total = round(sum(times.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
