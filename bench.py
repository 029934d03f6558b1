"""Benchmark: headline jobs at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query runs to completion through the ``noop`` sink (full execution, no
driver collect).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from piisift.plans.catalog import QUERIES  # noqa: E402
from piisift.session import get_spark  # noqa: E402

HEADLINE = [
    "guard_documents",
    "scrub_documents",
    "merge_spans",
    "risk_score",
    "document_report",
    "whitelist_impact",
    "risk_by_source",
    "llm_hybrid_merge",
    "stream_guard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="piisift-bench", shuffle_partitions=cpus * 2)
    # The bench tables are single files of one row group: deal the texts out to the cores.
    spark.conf.set("spark.piisift.inputPartitions", str(cpus))
    # Warm the JVM (class loading, code generation) by running every headline
    # query once on the smallest input; timings below are warm runs.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
