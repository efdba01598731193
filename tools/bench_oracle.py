"""Single-node brute-force reference: time the DuckDB oracle SQL of the
headline keys on the same tables (all pairs where the Spark jobs prune).

    python tools/bench_oracle.py [--sf /root/testdata/sf0.1]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from bench import HEADLINE  # noqa: E402
from sentier.oracle import ORACLE  # noqa: E402
from sentier.sources.tables import BASE_TABLES  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--threads", type=int, default=int(os.environ.get("BENCH_CPUS", "8")))
    a = ap.parse_args()
    con = duckdb.connect()
    con.execute(f"SET threads = {a.threads}")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    times = {}
    for k in HEADLINE:
        t0 = time.time()
        con.execute(ORACLE[k]).fetchall()
        times[k] = round(time.time() - t0, 3)
    print(json.dumps({"engine": "duckdb-oracle", "sf": os.path.basename(a.sf.rstrip("/")), "queries": times,
                      "total": round(sum(times.values()), 3)}))


if __name__ == "__main__":
    main()
