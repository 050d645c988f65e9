"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trackspark.plans.catalog import load
from trackspark.plans.views import Views
from trackspark.session import local_session

HEADLINE = (
    "a1_track_summary", "j1_shot_lookup", "j3_calibration_at_pts", "j4_play_time_at_pts", "j7_track_conflicts", "p6_homography_projection", "p8_observation_projection",
    "w3_local_spike_cuts", "w9_play_time_dedupe", "w10_gap_sessions", "w11_stride_throttle", "w13_trail_window", "j8_injective_matches", "a7_shot_metrics", "a10_ground_contact_error",
    "a12_cross_shot_identity", "a2_team_by_prototype", "k3_observation_csv", "s1_detection_log_scan", "g7_iou_tracker",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    registry = load()
    spark = local_session("bench", cores)
    views = Views(spark, sf_dir)
    times: dict[str, float] = {}
    for name in names:
        fn, _ = registry[name]
        spent = []
        for i in range(runs + 1):
            start = time.perf_counter()
            fn(views).write.format("noop").mode("overwrite").save()
            if i or runs == 0:
                spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent), 3)
    rows = views.obs.count()
    tracked = times.get("g7_iou_tracker")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir, "cores": int(cores), "spark": spark.version,
        "observation_rows": rows, "tracker_frames_per_s": round(views.obs.select("shot_id", "frame_index").distinct().count() / tracked, 1) if tracked else None,
    }))


if __name__ == "__main__":
    main()
