"""Benchmark of the headline queries.

Loads the roster and contact snapshots once (timed as ``load``), then runs
every headline query once (``cold``, all of them together) and three more times on
the warm session, and records the median wall time of a full evaluation (``noop``
sink: every row is produced, none is collected).  Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "common_friend_count",
    "common_friend_all_callers",
    "relation_all_callers",
    "contacts_by_prestige_page",
    "contacts_page_all_callers",
    "friends_two_hop_strict",
    "relation_table",
    "contacts_by_affinity_page",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    from amity.plans import loaded
    from amity.plans.registry import QUERIES
    from amity.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(cpus, 8), app_name="amity-bench")
    t0 = time.perf_counter()
    loaded.loaded_roots(spark, sf_dir)
    load_s = time.perf_counter() - t0

    times: dict[str, float] = {}
    cold = 0.0
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up, not in the sum
        cold += time.perf_counter() - t
        samples = []
        for _ in range(runs):
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "load_sec": round(load_s, 3),
        "cold_sec": round(cold, 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
