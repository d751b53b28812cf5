"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).  Every query runs to
completion through the no-op sink (full execution, nothing collected).
"""

from __future__ import annotations

import json
import os
import re
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("trust_by_level", "features_all", "stats_summary", "roc_auc", "pr_curve",
            "eda_describe", "image_risk", "validate_accounts", "scraped_accounts",
            "balanced_sample", "stream_hourly", "permutation_importance")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from trustframe.session import build_session
    from trustframe.plans.registry import queries

    spark = build_session(f"local[{cpus}]", "trustframe-bench", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    qs = queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in qs]
    # warm-up: JVM, codegen caches, Parquet footers
    qs["trust_by_level"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    m = re.search(r"sf([0-9.]+)", sf_dir)

    def report() -> None:
        out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
               "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}
        late = [n for n in names if n not in times]
        print(json.dumps(out | ({"unfinished": late} if late else {})), flush=True)

    def stopped(*_) -> None:        # a time limit from outside: say what was measured
        report()
        os._exit(1)

    signal.signal(signal.SIGTERM, stopped)
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    report()
    spark.stop()


if __name__ == "__main__":
    main()
