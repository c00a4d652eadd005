"""Headline queries, timed: one JSON line.  BENCH_SF_DIR names the tables' folder, BENCH_CPUS the cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from graphlake.queries import QUERIES

#: Scan, arithmetic, one hop, three hops, counts, siblings, uniqueness, text, nested lists, an incremental subscription.
HEADLINE = ["get_where_gt", "where_long_arithmetic", "hop1", "hop3", "hop_items", "count_where", "count_show_cond", "siblings", "unique_count", "text_phrase", "graphql_nested", "subscription_replay"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "total of headline queries, best of two after a warm-up", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
