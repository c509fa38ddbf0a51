"""Headline queries at one scale factor: one warm-up, then the median of the timed runs, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from framegate.plans.registry import queries  # noqa: E402
from framegate.runtime import local_session  # noqa: E402

HEADLINE = [
    "A1_gate_summary", "A2_count_maps", "A5_mask_iou_dice", "A6_threshold_sweep", "A8_veto_threshold", "A13_veto_sweep",
    "A17_mask_geometry", "C1_connected_components", "E1_ranker_vector", "E3_dense_vectors", "E28_selector_rules",
    "F10_gate_with_dominant_reason", "J6_tiered_match", "J8_rule_join", "J9_circle_neighbours", "J12_context_distances",
    "J13_tolerance_join", "J16_pixels_in_boxes", "P11_flatten_numeric", "ST6_incremental_summary", "U7_gold_board",
    "U14_crop_index", "W1_frame_winner", "W2_top_candidates", "W7_thin_sequence", "W9_suppress_overlaps",
    "W14_random_split", "W17_temporal_split", "policy_winner_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "framegate-bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    timings: dict[str, float] = {}
    for name in names:
        samples = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(samples[1:] or samples), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_warm_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": float(scale)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
