"""Benchmark the headline queries.

Runs each query ``BENCH_RUNS`` times (default 3) with a freshly built plan
(no reuse of shuffle files between runs), forcing full evaluation with the
``noop`` sink, and prints ONE JSON line with the median seconds per query.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_QUERIES (comma list, default headline set).
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "link_disposition_counts",
    "token_relation",
    "element_extents",
    "cleaned_content",
    "menu_rows",
    "link_dispositions",
    "crawl_closure",
    "segmented_slugs",
    "page_payload",
    "outbox_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from sitemill.plans.catalog import QUERIES
    from sitemill.session import local_session

    spark = local_session(cpus, app="sitemill-bench")
    # warm the JVM (JIT, class loading) once; not measured
    QUERIES["link_disposition_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    results: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 3)
        print(f"# {name}: {results[name]}s (runs {[round(t, 2) for t in times]})", file=sys.stderr, flush=True)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "median_seconds_sum_headline_queries",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
