import pytest

from cueline.operators import experiments, scoring
from cueline.params import SubtitleParams


def metrics(score, critical=5, fragments=5, passed=False):
    return {"overall_score": score, "critical_issue_count": critical, "subtitle_fragment_count": fragments, "passed": passed}


@pytest.mark.parametrize(
    "after,wanted",
    [
        (metrics(80.0), False), (metrics(80.5), True), (metrics(80.2, critical=4), True), (metrics(79.95, fragments=4), True),
        (metrics(79.0, fragments=4), False), (metrics(70.0, passed=True), True),
    ],
)
def test_improves(spark, after, wanted):
    before = metrics(80.0)
    assert experiments.improves(before, after) is wanted
    table = lambda m: spark.createDataFrame([(1, *m.values())], "k int, overall_score double, critical_issue_count int, subtitle_fragment_count int, passed boolean")
    row = experiments.compare_metrics(table(before), table(after), ["k"], ["overall_score"]).first()
    assert row.improved is wanted and row.regressed is (after["overall_score"] < 80.0)


def test_loop_keeps_and_discards(spark):
    def measure(params):
        if params.max_chars == 99:
            raise ValueError("no")
        return spark.createDataFrame([tuple(metrics(50.0 + params.max_chars).values())], "overall_score double, critical_issue_count int, subtitle_fragment_count int, passed boolean")

    trial = experiments.Experiment(SubtitleParams(), measure)
    trial.set_baseline()
    assert trial.run({"max_chars": 20})["kept"]
    assert not trial.run({"max_chars": 10})["kept"]
    assert trial.run({"nothing": 1})["notes"].startswith("VALIDATION FAILED")
    assert trial.run({"max_chars": 99})["notes"].startswith("EXPERIMENT FAILED")
    assert trial.params.max_chars == 20
    assert trial.status() == {"direction": "general_quality", "experiment_count": 4, "baseline_score": 68.0, "current_score": 70.0}
    log = trial.log(spark)
    assert [r.metrics_before["overall_score"] for r in log.orderBy("experiment_id").collect()] == [68.0, 70.0, 70.0, 70.0]
    summary = experiments.experiment_summary(log, ["direction"]).first()
    assert (summary.total_experiments, summary.improvements, summary.regressions, summary.improvement_rate) == (4, 1, 1, 25.0)


def test_adapt():
    params, changed = experiments.adapt_params({"reading_speed_too_fast", "gap_too_short", "duration_too_short", "line_too_long"}, SubtitleParams())
    assert changed == ["max_chars", "min_display_s", "min_gap_s", "reading_speed"]
    assert (params.reading_speed, params.max_chars, params.min_display_s) == (4.5, 17, 0.9)
    assert params.min_gap_s == pytest.approx(0.047)
    assert experiments.adapt_params(set(), SubtitleParams()) == (SubtitleParams(), [])


def test_stagnation(spark):
    scores = [50, 60, 60, 55, 60, 59, 58, 57, 61]
    rows = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "k int, pos bigint, overall_score double")
    for size in (2, 100):
        got = experiments.best_so_far(rows, ["k"], size=size).orderBy("pos").collect()
        assert [r.improved for r in got] == [True, True] + [False] * 6 + [True]
        assert [r.stagnation for r in got] == [0, 0, 1, 2, 3, 4, 5, 1, 0]


def test_recommend(spark):
    rows = spark.createDataFrame([(1, 1, 0, 5), (2, 0, 0, 0)], "k int, audio_abrupt_start_count int, audio_abrupt_end_count int, critical_issue_count int")
    with pytest.raises(ValueError, match="word_level_error_count"):
        experiments.recommend(rows, ["k"])
    others = {r[i] for r, _ in experiments.STRATEGY_RULES for i in range(0, len(r), 3)} - set(rows.columns)
    got = experiments.recommend(rows, ["k"], fallback=["low_risk"], unmeasured=sorted(others)).orderBy("k", "ord").collect()
    assert [(r.k, r.strategy) for r in got] == [
        (1, "improve_cut_points"), (1, "improve_crossfade"), (1, "improve_topic_segmentation"), (2, "low_risk"),
    ]


def test_efficiency(spark):
    rows = spark.createDataFrame([("a", 3, 0), ("b", 1, 3), ("c", 0, 0), ("d", 3, 1)], "v string, generated int, skipped int")
    got = {r.v: r.efficiency_score for r in scoring.efficiency(rows, ["v"]).collect()}
    assert got == {"a": 100.0, "b": 100.0, "d": 75.0}


def test_style_deductions(spark):
    files = spark.createDataFrame([("v", "BorderStyle,3 Noto Sans SC ScaledBorderAndShadow"), ("v", "plain"), ("w", "plain")], "v string, content string")
    got = {r.v: r.style_score for r in scoring.style_deductions(files, ["v"]).collect()}
    assert got == {"v": 75.0, "w": 75.0}
