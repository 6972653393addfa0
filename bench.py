"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS set the data and the cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from gridloom.plans import catalog
from gridloom.plans.session import session

NAMES = [
    "flagship", "group_sum", "group_mean", "group_std", "filter_gt", "sort_asc", "sort_desc", "join_inner", "join_outer", "rolling_mean", "rolling_mean_global",
    "ewm", "pivot_sum", "melt", "describe", "csv_roundtrip", "parquet_roundtrip", "arr_add", "arr_reductions", "arr_sum_axis", "matmul_gram", "conv2d",
]
RUNS = 3


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        times = []
        for _ in range(RUNS + 1):  # the first compiles
            start = time.perf_counter()
            catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
