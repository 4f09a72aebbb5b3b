"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Stages of the flagship are timed in the order in which they feed each other, each
once and written out in full; `flagship` is their sum, from the raw events table to
the finished context of every signal. The other queries start from the landed
telemetry. Lines beyond the JSON go to stderr.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

STAGES = ["events", "ids", "sigs", "deps", "nbrs", "features", "causes", "chains", "graded", "edge_outcomes", "memory", "matches"]
QUERIES = ["SRC4", "FIL3", "FIL4", "SCL14", "JOI1", "JOI2", "JOI6", "JOI12", "G7", "CAU5", "TPL2.logs", "TOP3", "TOP5",
           "AGG4", "AGG10", "AGG11", "SIM11", "REP2", "REP7", "REP9", "STR7"]


def main() -> None:
    from pyspark.sql import SparkSession

    from opsrecall.plans import catalog
    from opsrecall.plans.landing import landing

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("opsrecall-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    took: dict[str, float] = {}
    a = landing(spark, sf_dir)

    def timed(name, run) -> None:
        t = time.time()
        run()
        took[name] = round(time.time() - t, 3)
        print(f"{name:20s} {took[name]:8.3f}", file=sys.stderr, flush=True)

    for stage in STAGES:
        timed(f"stage:{stage}", lambda: getattr(a, stage))
    timed("stage:context", lambda: a.context)
    flagship = sum(took.values())
    n = a.context.count()
    queries = catalog.queries()
    for key in QUERIES:
        timed(key, lambda: queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save())
    took["flagship"] = round(flagship, 3)
    total = sum(v for k, v in took.items() if not k.startswith("stage:"))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(total, 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1],
        "signals": n, "ms_per_signal": round(1000 * flagship / max(n, 1), 3),
        "events_per_sec": round(a.events.count() / max(took["stage:events"], 1e-6), 1)}))


if __name__ == "__main__":
    main()
