"""Benchmark the headline queries.

Runs every query registered with ``headline=True`` on the tables under
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``;
each result is fully computed into Spark's ``noop`` sink (no collect).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("SISMO_MASTER", f"local[{cpus}]")
    from sismo.plans import registry
    from sismo.session import build_session, scratch_scope

    spark = build_session(shuffle_partitions=int(cpus))
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sismo-bench-"))
    registry.load_all()
    runners = {n: registry.QUERIES[n] for n in registry.HEADLINE if n in registry.QUERIES}
    names = list(runners)
    only = os.environ.get("BENCH_ONLY")
    if only:
        names = [n for n in names if n in only.split(",")]
    # warm the JVM / Python workers once on a tiny query
    registry.QUERIES["cell_aggregate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        with scratch_scope(spark):
            t0 = time.perf_counter()
            df = runners[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
