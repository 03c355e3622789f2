"""Headline queries timed on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time

from cliplab.plans import QUERIES
from cliplab.session import local_session

HEADLINE = (
    "h14_mean_prob_metrics",
    "h02_binary_metrics",
    "h04_auroc",
    "h07_threshold_sweep",
    "h06_roc_points",
    "h08_best_threshold",
    "h19_compare_methods",
    "h17_moving_avg_topk",
    "h18_gaussian_topk",
    "h20_placement_values",
    "h21_delong_frames",
    "h22_delong_clips",
    "h09_bootstrap_ci",
    "h10_bootstrap_clip_ci",
    "h26_heldout_fold_metrics",
    "h23_friedman",
    "g02_patient_split",
    "g03_cv_folds",
    "g05_sample_train",
    "f05_uniform_stride",
    "d10_frames_in_windows",
    "a03_manifest_from_paths",
    "e08_dataset_statistics",
    "e13_manifest_quality",
    "e14_patient_overlap",
    "e16_routing_statistics",
    "e19_duration_statistics",
    "e24_five_numbers",
    "f07_duplicate_keeper",
    "b08_stopwatch_seconds",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), shuffle_partitions=8, memory="12g")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executor threads

    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": total, "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
