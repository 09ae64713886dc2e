"""Times headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Each query is run
to its end by the no-op sink, after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from pyspark.sql import SparkSession  # noqa: E402

from nearsieve.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = [
    "feature_hash",
    "bucket_address",
    "reservoir_index",
    "knn_exact_count",
    "knn_sketch_linear",
    "knn_sketch_tree",
    "s_at_k",
    "exact_jaccard_knn",
    "recall_at_k",
    "ngram_stats",
    "knn_contamination",
    "mean_pairwise_cosine",
    "heavy_hitters_users",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["feature_hash"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
