"""Headline-query benchmark.

Runs the blueprint's headline jobs on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query is fully executed with a no-op sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from sentier.registry import REGISTRY  # noqa: E402
from sentier.session import build_session  # noqa: E402

HEADLINE = ["feedback_dashboard", "nearest_stop", "plan_transit_trips", "recommend_places",
            "vector_knn", "rag_retrieve", "wallet_balances"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    # Warm-up, not timed: each headline job once on the smallest tables, so
    # class loading and first code generation are not billed to one query.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for k in keys:
            REGISTRY[k](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t0 = time.time()
        REGISTRY[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
