"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

A query that fails is named in the line, the others are timed all the same, and the exit code is 1.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tracelake.plans import catalog

QUERIES = ["dfg_edges", "norm_report", "norm_event_log_start_else_complete", "causal_edges", "l2_patterns", "model_edges_fulfilment", "variants_table", "variants_top_k", "case_statistics", "cycle_time_histogram", "replay_documented", "replay_modal", "bottlenecks", "rework_cases", "rework_activities"]


def main() -> int:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    found["activity_counts"](spark, sf_dir).collect()  # warm-up
    seconds, failed = {}, {}
    for name in QUERIES:
        began = time.perf_counter()
        try:
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001  told in the line
            failed[name] = str(e)[:300]
            continue
        seconds[name] = round(time.perf_counter() - began, 3)
    line = {"metric": "process mining queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}
    print(json.dumps(line | ({"failed": failed} if failed else {})), flush=True)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
