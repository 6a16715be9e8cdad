"""Headline queries, timed: prints one JSON line.

The ten configurations run over the log view of ``lineitem`` written once as a text file,
so each reads and parses text, all through ``Engine.output``; three registered queries follow.
The configurations have one warm-up each; of ``RUNS`` runs the mean counts. ``BENCH_SF_DIR`` and
``BENCH_CPUS`` say where and how wide.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

RUNS = 1
HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)


def main() -> None:
    from pyspark.sql import SparkSession

    from quern.plans import views
    from quern.plans.planner import Engine
    from quern.plans.query import Query
    from quern.plans.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        view = views.lineitems(spark, sf_dir)
        view.coalesce(1).select("value").write.text(f"{folder}/log", lineSep="\n")
        engine = Engine(spark, [f"{folder}/log"])
        lines = spark.read.text(f"{folder}/log").count()

        def noop(df):
            df.write.format("noop").mode("overwrite").save()

        def text(**options):
            return lambda: [noop(part) for part in engine.output(Query(**options))]

        runs = {
            "passthrough_no_filter": text(),
            "filter_flag": text(where=("flag=R",)),
            "count_only": text(count=True),
            "group_by_flag": text(count=True, group_by=("flag",)),
            "bucket_30d": text(count=True, bucket="720h"),
            "n_buckets_10": text(count=True, n_buckets=10),
            "parallel_filter": text(where=("flag=R",), parallel=4),
            "json_emit": text(where=("flag=R",), json=True),
            "sort_by_time": text(where=("flag=R",), sort_by="time"),
            "time_window": text(time_from="1995-01-01", time_to="1996-01-01", count=True),
        }
        for name in ("lineitem_log_pricing", "orders_log_priority", "group_by_two"):
            runs[name] = lambda name=name: noop(QUERIES[name](spark, sf_dir))
        took = {}
        for name, run in runs.items():
            if name not in QUERIES:
                run()  # warm-up
            times = []
            for _ in range(RUNS):
                start = time.perf_counter()
                run()
                times.append(time.perf_counter() - start)
            took[name] = round(sum(times) / RUNS, 3)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "log_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "lines": lines, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
