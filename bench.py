"""Time the registered queries and print one JSON line.

BENCH_SF_DIR names the parquet folder, BENCH_CPUS the local cores, BENCH_QUERIES an optional
comma-separated subset. Each query is run once to a no-op sink after a short warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pairwright.catalogue import QUERIES
from pairwright.session import build_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or list(QUERIES)
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, folder, "duplicate_keys")
    seconds, failed = {}, {}
    for name in chosen:
        start = time.perf_counter()
        try:
            run(spark, folder, name)
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # one broken query must not hide the other timings
            failed[name] = str(error).splitlines()[0][:200]
        print(f"{name} {time.perf_counter() - start:.2f}s", file=sys.stderr, flush=True)
    report = {
        "metric": "total_wall_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        report["failed"] = failed
    print(json.dumps(report))
    spark.stop()


def run(spark, folder: str, name: str) -> None:
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()


if __name__ == "__main__":
    main()
