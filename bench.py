"""Times the headline queries once each after a warm-up; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans import catalog

HEADLINE = ["scorecard", "w01_nearest_rank", "a05_averaged_median", "a10_entropy", "w06_skyline", "a14_curve_groups", "w02_plateau", "j10_asof_block", "j11_overlap", "b08_batch_work", "w08_merge", "a19_outcome_counts", "a24_ordered_hash"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    run("scorecard")
    took = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
