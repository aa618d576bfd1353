"""Timed headline queries: one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query runs once to warm up the session
and is then timed with a sink that reads every row and column.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from nearlake.plans import QUERIES

HEADLINES = (
    "knn_l2",
    "knn_by_matrix",
    "knn_with_query_label",
    "range_search",
    "recall_with_ties",
    "centroid_assign",
    "multi_shard_merge",
    "adaptive_multi_shard_search",
    "inverted_list_search",
    "product_codes",
    "asymmetric_distance_topk",
    "two_phase_search",
    "knn_graph",
    "kd_tree_leaves",
    "value_statistics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        for _ in range(2):  # the second run counts
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
