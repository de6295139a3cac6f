"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = ["q_daily_sales", "q_branch_daily", "q_sales_vs_target", "q_incentive", "q_customer_monitoring", "q_sales_monitoring", "q_o2c_flow", "q_o2c_funnel", "q_gift_windows", "q_rfm", "q_pareto", "q_trend_stats", "q_idf", "q_price_validation", "q_anomalies"]


def main() -> None:
    from pyspark.sql import SparkSession

    from tallyspark.queries import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first also compiles
            t = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
