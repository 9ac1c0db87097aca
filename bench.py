"""Wall time of the headline queries: one warm-up, then the median of three runs. Prints one JSON line."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from fathom import queries as retrieval

NAMES = "knn_cosine knn_l2 knn_dot knn_filter_eq knn_overfetch knn_batch_cosine ivf_probe_2 sq_codes bm25_topk bm25_filter_lang hybrid_default filter_json_range changelog_latest tenant_usage tier_policy".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = retrieval.queries(), {}
    for name in NAMES:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(median(runs[1:]), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
