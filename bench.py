"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully with the ``noop`` sink (no driver collect) and
timed; prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "zonal_burned_area", "annual_composite", "coarse_grid", "grid_param_sweep", "polygon_zone",
    "compare_products", "burn_fraction_monthly", "bilinear_resample", "balanced_sample", "stratified_split",
    "pr_curve", "area_match_threshold", "loyo_summary", "covariate_shift", "join_predictors",
    "area_multi_threshold", "incremental_annual_mask",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cinder.plans.catalog import QUERIES
    from cinder.session import build_session
    spark = build_session(f"local[{cpus}]", int(cpus) * 2)
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
