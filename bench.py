"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice into a no-op sink and the second run counts, so that start-up and code
generation are not what is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "skill_score",
    "met_level2",
    "segment_rolling",
    "station_hourly_to_daily",
    "daily_mean_max_min",
    "join_stages",
    "sample_linear",
    "regrid_linear",
    "pixel_window_join",
    "multiscale_radius",
    "progressive_window",
    "robust_window_stats",
    "province_join",
    "snap_to_valid",
    "lag1_prior",
    "pairwise_disagreement",
    "persistence_baseline",
    "climatology_baseline",
    "evaluate_predictions",
    "metrics_by_month",
    "metrics_by_station",
    "daily_affine_fit",
    "grid_day_stats",
    "data_quality_report",
    "fit_medians",
    "stratified_block_split",
    "nested_month_station_folds",
    "write_date_partitions",
    "stream_hourly_to_daily",
    "train_gbt",
    "score_grid",
]


def main() -> None:
    from hazeloom.plans import REGISTRY
    from hazeloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
