"""Time the headline queries, each from cold inputs, and print one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of cores. Every query starts without
the intermediate results of the others: ``plan_metrics`` is a whole compile.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wavelane import registry  # noqa: E402
from wavelane.session import local_session  # noqa: E402

HEADLINE = [
    "footprint",
    "conflict_edges",
    "task_degree",
    "connected_components",
    "colour_waves",
    "plan_metrics",
    "supplier_components",
    "supplier_degree",
    "class_admission",
    "hourly_rate",
    "inflight_balance",
    "running_duration_estimate",
    "plan_as_of",
    "footprint_range_join",
    "apply_outcomes",
    "progress_snapshot",
    "batch_assign",
    "cms_estimate",
    "stream_inflight",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", **{"spark.sql.shuffle.partitions": cores})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in names:
        registry.forget_inputs()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    tasks = spark.read.parquet(f"{folder}/orders.parquet").count()
    result = {
        "metric": "headline queries, cold",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if "plan_metrics" in seconds:
        result["planned_tasks_per_sec"] = round(tasks / seconds["plan_metrics"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
