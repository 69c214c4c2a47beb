"""Times every report over a stored hits table; prints one JSON line.

The tables at $BENCH_SF_DIR are turned into a hits table once (timed apart, as
``build_hits``); each report then reads that table with its load order, which
decides the first row of a message.
One warm-up, then the median of $BENCH_RUNS runs with the result written to
Spark's ``noop`` sink.
"""

import json
import os
import statistics
import sys
import tempfile
import time

from hitprism.plans.catalog import OPERATORS
from hitprism.session import local_session
from hitprism.sources.hits import read_hits
from hitprism.sources.star import hits_from_star

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
ONLY = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]

# The account periods and the reports; not their variants, nor plain columns.
HEADLINE = [n for n in OPERATORS if n[0] in "PR" and "_" not in n]


def run(operator, hits):
    start = time.perf_counter()
    operator(hits).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    spark = local_session(CPUS, shuffle_partitions=CPUS, memory="12g", app="bench")
    path = tempfile.mkdtemp(prefix="hitprism-bench-") + "/hits"
    start = time.perf_counter()
    hits_from_star(spark, FOLDER).write.parquet(path)
    build = time.perf_counter() - start
    hits = read_hits(spark, path, keep_row_order=True)

    seconds = {}
    for name in ONLY or HEADLINE:
        run(OPERATORS[name], hits)
        times = [run(OPERATORS[name], hits) for _ in range(RUNS)]
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "seconds over all reports",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "build_hits": round(build, 3),
        "rows": hits.count(),
        "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
