"""Times the headline queries over one folder of tables and prints one JSON line.

Every query starts from the given tables in a workspace of its own, so none profits from what
another one has stored.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from daybook.plans.catalog import QUERIES  # noqa: E402
from daybook.plans.workspace import Workspace  # noqa: E402
from daybook.session import build_session  # noqa: E402

HEADLINE = [
    "integrity_report",
    "densify_panel",
    "lag_features",
    "rolling_features",
    "baseline_scores",
    "all_metrics",
    "day_type_breakdown",
    "residual_summary",
    "acf",
    "periodogram",
    "rank_correlations",
    "subgroup_metrics",
    "block_bootstrap",
    "build_features",
    "seasonal_arx",
    "stage1_window",
    "oof_predictions",
    "tree_direct",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    Workspace(spark, sf_dir).span  # starts the executors
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    timings = {}
    for name in chosen:
        started = time.perf_counter()
        QUERIES[name](Workspace(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    result = {
        "metric": "headline_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
