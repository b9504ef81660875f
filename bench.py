"""Benchmark: every registered report at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

1. ingest: the star tables are mapped to raw invoice lines once and written
   as month-partitioned Parquet (what a deployment stores);
2. every registered job runs over that raw table and is executed to the end
   with the ``noop`` sink (no driver collect); wall time per job, each job
   from scratch (its own relations);
3. batch mode: all jobs again over one shared set of relations (each basis'
   invoice grain materialised once), total wall time.

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k]

    from tillroll.registry import JOBS
    from tillroll.relations import Relations
    from tillroll.session import build_session
    from tillroll.sources.files import read_raw_parquet, write_raw_parquet
    from tillroll.sources.star import raw_from_star
    from tillroll.storage import fresh_path

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus), app="tillroll-bench")
    scratch = fresh_path(spark, "bench-raw")

    t0 = time.perf_counter()
    write_raw_parquet(raw_from_star(spark, sf_dir), scratch)
    ingest = time.perf_counter() - t0

    rel_factory = lambda **kw: Relations(read_raw_parquet(spark, scratch), home_country="NATION_0", **kw)
    keys = only or list(JOBS)
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for key in keys:
        runs = []
        for _ in range(repeat):
            t = time.perf_counter()
            try:
                JOBS[key](rel_factory()).write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001
                failed[key] = f"{type(e).__name__}: {str(e)[:200]}"
                break
            runs.append(time.perf_counter() - t)
        if runs:
            times[key] = round(statistics.median(runs), 3)
    # Batch mode: all reports from one set of relations, the way a nightly run
    # produces them (each basis' invoice grain is materialised once and shared).
    batch_total = None
    if os.environ.get("BENCH_BATCH", "1") == "1" and not only:
        shared = rel_factory(shared=True)
        t = time.perf_counter()
        for key in keys:
            if key in failed:
                continue
            JOBS[key](shared).write.format("noop").mode("overwrite").save()
        batch_total = round(time.perf_counter() - t, 3)
    spark.stop()

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_wall_time_all_reports",
        "value": round(sum(times.values()) + ingest, 3),
        "unit": "sec",
        "queries": times,
        "ingest_sec": round(ingest, 3),
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "n_queries": len(times),
        "batch_all_reports_sec": batch_total,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
