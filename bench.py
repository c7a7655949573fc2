"""Seconds per headline query. Prints one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local cores. The
derived transcript table is written first and timed as its own query, as the
ingest step of a real corpus would be; each query then runs to completion into
the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cueline.plans import fixtures, registry
from cueline.session import local_session

HEADLINE = (
    "clip_audit", "previous_gap", "context_window", "silence_points", "clip_entries", "clip_subtitles", "display_text",
    "normalised_text", "fixpoint_corrections", "errata_violations", "asr_detection", "contextual_errata",
    "timing_issues", "content_issues", "alignment_issues", "timing_scores", "content_scores", "alignment_reports",
    "combined_audit", "quality_reports", "merged_short_segments", "subtitle_entries", "merged_clip_entries",
    "topic_segments", "topics", "version_plans", "quiet_runs", "nearest_silence", "abrupt_edges",
    "trial_comparison", "best_so_far", "experiment_summary", "errata_violations_by_join", "srt_files", "split_segments",
    "report_metrics", "parameter_sweep", "keep_or_discard",
)
LONG_S = 4.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    registry.load()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "cueline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    spark.range(1).count()
    for name, make in (
        ("ingest_segments", fixtures.segments), ("ingest_open_segments", fixtures.open_segments),
        ("ingest_audio_frames", fixtures.audio_frames), ("ingest_experiments", fixtures.ordered_experiments),
    ):
        timed(name, lambda: make(spark, sf_dir).count())
    wanted = os.environ.get("BENCH_QUERIES")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    for name in wanted.split(",") if wanted else HEADLINE:
        took = []
        while len(took) < 2 or len(took) <= runs and took[0] <= LONG_S:
            timed(name, lambda: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
            took.append(times[name])
        times[name] = statistics.median(took[1:])
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
