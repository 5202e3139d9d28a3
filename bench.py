"""Time every query: one warm-up, then the median of BENCH_RUNS runs (three), full results forced; queries whose warm-up
takes more than LONG seconds are timed once.

Reads BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS] and prints one JSON line.
"""

import json
import os
import statistics
import sys
import time

import pyspark

from chatlens.catalog import QUERIES
from chatlens.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
LONG = 5


def timed(spark, query):
    started = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main():
    spark = local_session(CPUS, CPUS, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or list(QUERIES)
    seconds = {}
    for name in chosen:
        warm, runs = timed(spark, QUERIES[name]), []
        while len(runs) < (RUNS if warm < LONG else 1):
            runs.append(timed(spark, QUERIES[name]))
        seconds[name] = round(statistics.median(runs), 4)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    rows = {
        t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count()
        for t in ("events", "documents", "lineitem", "conversations", "pages", "labels")
    }
    print(json.dumps({
        "metric": "total of median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows": rows,
        "cpus": CPUS,
        "spark": pyspark.__version__,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
