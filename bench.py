"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line (warm: the last of three runs counts).

The sample rows are first written once as a merged tree with its table of newest values, as an engine would hold them;
``store`` is what that took, ``floor`` a Spark job that reads one row of it."""

import atexit
import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from tidelake.queries import QUERIES
from tidelake.sources import adapters

HEADLINE = ["range_paths", "bucket_average", "bucket_multi_series", "object_last", "matrix_pivot", "sma_bucketed", "ema_bucketed", "list_paths", "snapshot_now", "snapshot_past", "deltas_grouped", "ingest_filter_glob"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="tidelake-bench-")
    atexit.register(shutil.rmtree, folder, True)
    began = time.time()
    adapters.store(spark, sf_dir, f"file://{folder}")
    stored = round(time.time() - began, 3)
    for _ in range(3):
        began = time.time()
        adapters.newest_values(spark, sf_dir).limit(1).write.format("noop").mode("overwrite").save()
        floor = round(time.time() - began, 3)
    times = {}
    for name in HEADLINE:
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "store": stored, "floor": floor, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
