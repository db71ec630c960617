"""Benchmark the headline queries.

Runs each query in ``HEADLINE`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` into a ``noop`` sink (full
execution, no output cost): one warm-up run of the flagship, then the median
of ``$BENCH_REPEATS`` (default 1) runs per query. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewlens.plans.catalog import QUERIES  # noqa: E402
from reviewlens.session import get_session  # noqa: E402

HEADLINE = [
    "weekly_summary",
    "ingest_quality",
    "ingest_stage_counts",
    "redact_reviews",
    "ingest_dedup",
    "rating_distribution",
    "anonymised_reviews",
    "cluster_stats",
    "cluster_centroids",
    "cluster_representatives",
    "cluster_ranking",
    "quote_validation",
    "theme_attempts",
    "token_budget",
    "explore_feed",
    "explore_search",
    "theme_tags",
    "report_text",
    "dashboard_payload",
    "receipts_latest",
    "language_id",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t0
    spark.catalog.clearCache()  # no query reads what another has paid for
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = get_session(f"local[{cpus}]", "reviewlens-bench", shuffle_partitions=int(cpus) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if n in QUERIES]
    run_once(spark, names[0], sf_dir)  # warm-up: JVM, codegen, file listing
    times = {}
    for n in names:
        times[n] = round(statistics.median(run_once(spark, n, sf_dir) for _ in range(repeats)), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
