"""Whole jobs on small corpora."""

import json

import pytest
from conftest import segments_of
from pyspark.sql import functions as F
from test_merging import SCENARIO, many_rows

from cueline.operators import checks, merging, scoring
from cueline.operators.rules import Rules
from cueline.params import LATIN, PUBLISHING, SubtitleParams
from cueline.plans import jobs

KEY = ["transcript_id"]


def test_research_loosens_limits(spark):
    history = jobs.research(segments_of(spark, SCENARIO), KEY, SubtitleParams(), max_iterations=2)
    assert [h.number for h in history] == [1, 2]
    assert history[0].changed and history[1].params != history[0].params


def test_project(spark, tmp_path):
    (tmp_path / "t").mkdir()
    rows = [{"start": s / 1000, "end": e / 1000, "text": t} for s, e, t in SCENARIO]
    (tmp_path / "t" / "talk.json").write_text(json.dumps({"segments": rows}), encoding="utf-8")
    (tmp_path / "rules.json").write_text(json.dumps({"works": {"分叉": "分岔"}}), encoding="utf-8")
    segments, entries, rules = jobs.load_project(spark, str(tmp_path / "t"), str(tmp_path / "rules.json"))
    assert segments.count() == len(SCENARIO) and 0 < entries.count() < len(SCENARIO)
    shown = jobs.process_entries(entries, KEY, "pos", rules=Rules(literal=tuple(rules)))
    assert not [r for r in shown.collect() if "分叉" in r.text]


def test_clip_job_isolates_bad_clips(spark):
    clips = spark.createDataFrame(
        [("t", "good", "s", 0, 20000), ("t", "empty", "s", 90000, 95000), ("t", "bad", "s", 5000, 5000), ("t", "null", "s", None, 9)],
        "transcript_id string, clip_id string, series string, start_ms bigint, end_ms bigint",
    )
    entries = jobs.clip_job(segments_of(spark, SCENARIO), clips)
    results = {r.clip_id: (r.subtitle_count > 0, r.errors) for r in jobs.clip_results(clips, entries, ["transcript_id", "clip_id"]).collect()}
    assert results["good"] == (True, [])
    assert results["empty"] == (False, ["no subtitles"])
    assert results["bad"] == (False, ["end before start", "no subtitles"])
    assert results["null"] == (False, ["missing time", "no subtitles"])
    rows = entries.orderBy("index").collect()
    assert all(a.end_s <= b.start_s for a, b in zip(rows, rows[1:]))


def test_simple_subtitles(spark):
    rows = segments_of(spark, [(0, 500, "你好。"), (600, 2000, "  "), (700, 9000, "旧世界")])
    got = jobs.simple_subtitles(rows, KEY, corrections=[("旧", "新")]).orderBy("index").collect()
    assert [(r["index"], r.start_ms, r.end_ms, r.text) for r in got] == [(1, 0, 1000, "你好"), (2, 1067, 7700, "新世界")]


def test_sweep_gives_the_reports_of_single_settings(spark):
    """Entries stand beside their neighbours, so no window or sort comes after the merge (F2)."""
    rows = segments_of(spark, many_rows(), "a").union(segments_of(spark, many_rows(31), "b")).union(segments_of(spark, [(0, 300, "On")], "c"))
    settings = [("base", {}), ("again", {"max_chars": 42}), ("long", {"max_display_s": 12.0}), ("slow", {"reading_speed": 5.0})]
    swept = jobs.sweep(rows, KEY, LATIN, settings)
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    got = {r.param_id: r for r in swept.collect()}
    assert list(got) and set(got) == {name for name, _ in settings}
    overlaps = 0
    for name, changes in settings:
        entries = merging.transcript_to_entries(rows, KEY, LATIN.with_values(**changes))
        context = checks.with_segment_context(entries, KEY, "pos", LATIN)
        overlaps += context.where("gap_ms < 0").count()
        report = scoring.alignment_report(context, KEY, checks.alignment_family(LATIN, PUBLISHING), LATIN).agg(
            F.avg("alignment_score"), F.sum("critical_count"), F.sum("warning_count"), F.sum("total_segments"), F.count_if("publishing_ready")
        ).first()
        row = got[name]
        assert row.alignment_score == pytest.approx(report[0], abs=1e-9)
        assert (row.critical_count, row.warning_count, row.merged_count, row.n_publishing_ready) == tuple(report[1:])
    assert overlaps
