"""Loudness and abrupt edges are the issues of one file, and both reach the score and the report's counts."""

import pytest

from cueline.operators import audio, scoring

LEVELS = {1: [0.0] + [-30.0] * 8, 2: [-30.0] * 8 + [0.0], 3: [-30.0] * 9, 4: [0.0, -30.0], 5: [0.0] + [-30.0] * 7 + [0.0]}


@pytest.fixture(scope="module")
def issues(spark):
    loudness = spark.createDataFrame(
        [(1, -14.0, -3.0, 5.0), (2, -14.0, 0.0, 5.0), (3, -20.0, -3.0, 12.0), (4, -14.0, -3.0, 5.0), (5, None, None, None)],
        "file_id bigint, lufs double, true_peak double, lra double",
    )
    frames = spark.createDataFrame([(k, i, v) for k, row in LEVELS.items() for i, v in enumerate(row)], "file_id bigint, frame_idx bigint, rms_db double")
    return audio.file_issues(loudness, frames, ["file_id"])


def test_all_kinds_are_listed(issues):
    assert sorted((r.file_id, r.issue_type, r.severity, r.value) for r in issues.collect()) == [
        (1, "abrupt_start", "warning", 0.0), (2, "abrupt_end", "warning", 0.0), (2, "true_peak_exceeded", "critical", 0.0),
        (3, "loudness_out_of_range", "warning", -20.0), (3, "lra_too_high", "warning", 12.0),
        (5, "abrupt_end", "warning", 0.0), (5, "abrupt_start", "warning", 0.0),
    ]


def test_scores_count_them(spark, issues):
    files = spark.createDataFrame([(k, k != 4) for k in LEVELS], "file_id bigint, present boolean")
    scores = {r.file_id: (r.critical_count, r.warning_count, r.score) for r in scoring.audio_score(issues, files).collect()}
    assert scores == {1: (0, 1, 97.0), 2: (1, 1, 82.0), 3: (0, 2, 94.0), 4: (1, 0, 0.0), 5: (0, 2, 94.0)}


def test_report_counts_them(spark, issues):
    entries = spark.createDataFrame([(k, 10) for k in LEVELS], "file_id bigint, total_entries bigint")
    none = spark.createDataFrame([], "file_id bigint, score double, lufs double")
    style = spark.createDataFrame([], "file_id bigint, style_score double")
    rows = scoring.report_metrics(issues, entries, none, style, ["file_id"]).collect()
    assert {r.file_id: (r.audio_abrupt_start_count, r.audio_abrupt_end_count) for r in rows} == {1: (1, 0), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (1, 1)}
