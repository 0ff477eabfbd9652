"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line.

A query's time covers all of it: reading, time-points, plan and result (to a sink that discards). The flagship runs once before, to start Spark up.
"""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINES = ["purchase_after_error", "edit_twice", "conj_join", "anti_join", "once_finite", "eventually_finite", "since", "neg_since", "until", "negated_triangle", "nested_triangle", "linear", "star", "json_filter_project"]


def main() -> None:
    from pyspark.sql import SparkSession

    from tracewarden.queries import FLAGSHIP, QUERIES

    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run(FLAGSHIP)
    times = {}
    for name in HEADLINES:
        began = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
