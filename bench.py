"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the folder with the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rentgrid.plans import QUERIES  # noqa: E402
from rentgrid.session import local_session  # noqa: E402

HEADLINES = [
    "market_change", "quarantine_rows", "cascade_report", "kpis", "concentration", "stratum_prices", "shift_share",
    "compare_by_neighbourhood", "describe", "audit_duplicates", "corr_pairs", "ltm_validation", "event_items",
    "kruskal", "mann_whitney_pairs", "psi_table", "median_baseline", "honest_coverage", "class_metrics",
    "point_in_polygon", "comparables", "within_radius", "ring_sum", "moran", "rent_block", "hedonic_ridge",
    "model_ladder",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()      # start the executor threads
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
