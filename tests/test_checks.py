import pytest
from conftest import segments_of
from pyspark.sql import functions as F

from cueline.operators import audio, checks, scoring, topics
from cueline.operators.rules import Rules
from cueline.params import PUBLISHING, SubtitleParams, TopicParams
from cueline.plans import queries_checks

KEY = ["transcript_id"]
P = SubtitleParams()


def found(spark, rows, family, params=P):
    ready = checks.with_entry_context(segments_of(spark, rows), KEY, "seg_idx", "pos", params)
    return [(r.entry_index, r.issue_type) for r in checks.issues(ready, KEY, F.col("seg_idx"), family).orderBy("entry_index", "issue_type").collect()]


def aligned(spark, rows, family):
    ready = checks.with_segment_context(segments_of(spark, rows), KEY)
    return [(r.entry_index, r.issue_type) for r in checks.issues(ready, KEY, F.col("pos"), family).orderBy("entry_index", "issue_type").collect()]


def test_overlap(spark):
    assert found(spark, [(0, 3000, "甲"), (2500, 5000, "乙")], checks.overlap_with_next()) == [(0, "subtitle_overlap")]
    assert found(spark, [(0, 2000, "甲"), (2500, 5000, "乙")], checks.overlap_with_next()) == []


def test_timing_checks(spark):
    rows = [(0, 500, "短"), (600, 9000, "长"), (8000, 9000, "这是一段很快的话太快了吧"), (9030, 10500, "一二三四五六七八九十"), (20000, 22000, " ")]
    assert found(spark, rows, checks.display_duration(P)) == [(0, "duration_too_short"), (1, "duration_too_long")]
    assert found(spark, rows, checks.reading_speed(P)) == [(2, "reading_speed_too_fast"), (3, "reading_speed_fast")]
    assert found(spark, rows, checks.gap_to_previous(P)) == [(2, "overlap"), (3, "gap_too_short")]
    assert found(spark, rows, checks.text_quality(P)) == [(4, "empty_text")]
    assert found(spark, [(0, 2000, "一" * 31 + "\n短")], checks.family(checks.line_shape(P), checks.text_quality(P))) == [
        (0, "line_too_long"), (0, "no_punctuation"), (0, "too_many_lines"),
    ]


def test_line_shape_of_documents(spark, tmp_path):
    texts = ["a" * 43, "short", "b" * 44 + "\nshort\n" + "c" * 45, "a1 " * 42 + "\n", "\n", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries_checks.line_shape_issues(spark, str(tmp_path))
    assert got.columns == ["doc_id", "issue_type", "severity", "value"]
    assert sorted((r.doc_id, r.issue_type, r.value) for r in got.collect()) == [
        (0, "line_too_long", 43.0), (2, "line_too_long", 44.0), (2, "line_too_long", 45.0), (2, "too_many_lines", 3.0),
        (3, "too_many_lines", 2.0), (4, "too_many_lines", 2.0),
    ]


def test_text_checks(spark):
    rows = [(0, 2000, "這是,第一行\n第二行"), (2000, 4000, "一二三四五六七八九"), (4000, 6000, "的确不"), (6000, 8000, "那个那个嗯嗯嗯嗯 wrongword the")]
    family = checks.family(
        checks.traditional_characters("這說"), checks.one_line(), checks.punctuation(P), checks.line_edges(P), checks.fillers(P),
        checks.anomalies(P, True),
    )
    assert found(spark, rows, family) == [
        (0, "english_punctuation"), (0, "multi_line_subtitle"), (0, "traditional_chinese_detected"),
        (1, "context_anomaly"), (1, "no_punctuation"), (2, "line_end_forbidden"), (2, "line_start_forbidden"),
        (3, "context_anomaly"), (3, "context_anomaly"), (3, "meaningless_filler"), (3, "meaningless_filler"),
    ]
    assert found(spark, [(0, 2000, "一" * 19)], checks.entry_length(P)) == [(0, "line_too_long")]


def test_word_checks(spark):
    rows = [(0, 2000, "好好好的啊什么教"), (2000, 4000, "文学 博赫斯"), (4000, 6000, "博赫斯写作")]
    given = Rules(disambiguation=((("文学",), (("博赫斯", "博尔赫斯"),)),), dictionary=("写作", "博赫"))
    ready = checks.with_entry_context(segments_of(spark, rows), KEY, "seg_idx", "pos")
    got = checks.issues(ready, KEY, F.col("seg_idx"), checks.word_level(P, given, [("博", "波")])).orderBy("entry_index", "issue_type").collect()
    assert [(r.entry_index, r.issue_type.removeprefix("word_level_"), r.value) for r in got] == [
        (0, "asr_confusion", 5.0), (0, "filler_sound", 3.0), (0, "repeat_stutter", 0.0),
        (1, "contextual_disambiguation", None), (1, "custom_errata", None),
        (2, "contextual_disambiguation", None), (2, "contextual_disambiguation", None), (2, "custom_errata", None),
    ]
    once = checks.issues(ready, KEY, F.col("seg_idx"), checks.word_disambiguation(given, distinct=True))
    assert once.groupBy("entry_index").count().agg(F.max("count")).first()[0] == 1


def test_alignment_checks(spark):
    rows = [(0, 2000, "他说的话还没有说完"), (1400, 1700, "但是不对。"), (1600, 1600, "好。"), (6000, 8000, "完了。"), (7200, 9000, "没有")]
    assert aligned(spark, rows, checks.continuity()) == [(1, "timestamp_overlap"), (2, "timestamp_overlap"), (3, "large_gap"), (4, "timestamp_overlap")]
    assert aligned(spark, rows, checks.segment_duration()) == [(1, "too_short_segment"), (2, "zero_or_negative_duration")]
    assert aligned(spark, rows, checks.interruption_issues(P)) == [(4, "large_overlap_not_interruption")]
    assert aligned(spark, rows, checks.publishing(PUBLISHING)) == [
        (1, "reading_speed_exceeded"), (1, "subtitle_overlap"), (1, "subtitle_too_short"), (2, "subtitle_minor_overlap"),
        (2, "subtitle_too_short"), (4, "subtitle_overlap"),
    ]
    got = checks.interruptions(checks.with_segment_context(segments_of(spark, rows), KEY), KEY, P).orderBy("index").collect()
    assert [r.confidence for r in got] == ["high", "low", "low"]


def test_speaking_speed(spark):
    rows = [(0, 1000, "一二三四五六七八九十一二三"), (1000, 2000, "一二三四五六七八九"), (2000, 9000, "一二三四"), (9000, 9000, "零")]
    assert aligned(spark, rows, checks.speaking_speed(P)) == [
        (0, "impossible_speaking_speed"), (1, "fast_speaking_speed"), (2, "slow_speaking_speed"),
    ]


def test_content_score(spark):
    ready = checks.with_entry_context(segments_of(spark, [(0, 2000, "干净的话"), (2000, 4000, "博赫斯")]), KEY, "seg_idx", "pos")
    clean = scoring.content_score(ready, KEY, checks.content_family(P, Rules())).first()
    assert (clean.score, clean.accuracy_rate, clean.passed) == (100.0, 100.0, True)
    row = scoring.content_score(ready, KEY, checks.content_family(P, Rules(literal=(("博赫斯", "博尔赫斯"),)))).first()
    assert (row.score, row.accuracy_rate, row.passed, row.errata_error_count) == (70.0, 0.0, False, 2)


def test_scores_need_no_positions(spark):
    """Without positions the same issues are counted and no text is walked for them (F15, F20)."""
    texts = ["哈哈哈哈，来啊来啊", "什么要，什么教\n第二行啊", "博赫斯", ""]
    ready = checks.with_entry_context(segments_of(spark, [(i * 1500, i * 1500 + 1600, t) for i, t in enumerate(texts)]), KEY, "seg_idx", "pos")
    rules = Rules(literal=(("博赫斯", "博尔赫斯"),), dictionary=("来啊",))
    timing, content = checks.timing_family(P, rules, places=False), checks.content_family(P, rules, places=False)
    assert "aggregate" not in ready.select(timing, content)._jdf.queryExecution().optimizedPlan().toString()
    t = scoring.timing_score(ready, KEY, checks.timing_family(P, rules)).first()
    c = scoring.content_score(ready, KEY, checks.content_family(P, rules)).first()
    both = scoring.entry_scores(ready, KEY, timing, content)
    row = both.first()
    assert (row.timing_score, row.timing_passed, row["_tc"], row["_tw"]) == (t.score, t.passed, t.critical_count, t.warning_count)
    assert (row.content_score, row.accuracy_rate, row.content_passed, row["_cc"], row["_cw"]) == (c.score, c.accuracy_rate, c.passed, c.critical_count, c.warning_count)


def test_perfect_alignment(spark):
    rows = [(i * 2000, i * 2000 + 2000, "一二三四五六") for i in range(10)]
    ready = checks.with_segment_context(segments_of(spark, rows), KEY)
    report = scoring.alignment_report(ready, KEY, checks.alignment_family(P), P).first()
    assert report.alignment_score == pytest.approx(100.0) and report.publishing_ready


def test_abrupt_edges(spark):
    rows = [("a", i, -10.0 if i == 0 else -40.0) for i in range(8)] + [("b", 0, -10.0), ("b", 1, -40.0)]
    rows += [("c", i, float("-inf") if i < 2 else -30.0) for i in range(6)] + [("c", 6, 0.0)]
    frames = spark.createDataFrame(rows, "file_id string, frame_idx bigint, rms_db double")
    got = {(r.file_id, r.issue_type) for r in audio.abrupt_edges(frames, ["file_id"]).collect()}
    assert got == {("a", "abrupt_start"), ("c", "abrupt_end")}


@pytest.mark.parametrize("size", [2, 50_000])
def test_quiet_runs(spark, size):
    levels = [-50, -50, -10, -50, -10, -50, -50, -50]
    frames = spark.createDataFrame([("f", i, i * 100, float(v)) for i, v in enumerate(levels)], "f string, frame_idx bigint, t_ms bigint, rms_db double")
    got = audio.quiet_runs(frames, ["f"], -40.0, size=size).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 200), (300, 400), (500, 800)]


def test_topics(spark):
    rows = [(i * 3000, i * 3000 + 2000, "时间 分岔" if i < 5 else "花园 花园") for i in range(10)]
    params = TopicParams(min_topic_s=10.0, max_topic_s=600.0, silence_s=1.0)
    whole = topics.segment_topics(segments_of(spark, rows), KEY, params)
    small = topics.segment_topics(segments_of(spark, rows), KEY, params, size=3, fan_out=2)
    take = lambda df: [(r.pos, r.topic_no, r.topic_start) for r in df.orderBy("pos").collect()]
    assert take(whole) == take(small) == [(i, 1 + (i >= 5), 5 * (i >= 5)) for i in range(10)]
    got = topics.assemble_topics(whole, KEY, params).orderBy("topic_no").collect()
    assert [(r.topic_id, r.title, r.keywords, round(r.coherence, 3)) for r in got] == [
        ("topic_001", "时间", ["时间", "分岔"], 0.85), ("topic_002", "花园", ["花园"], 0.85),
    ]
    assert got[1].summary == " ".join(["花园 花园"] * 5)


def test_version_tail_joins_the_last_full_version(spark):
    rows = [("t", i, f"topic_{i:03d}", ["a"] if i % 2 else ["b"], i * 1000, i * 1000 + 500) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "transcript_id string, topic_no bigint, topic_id string, keywords array<string>, start_ms bigint, end_ms bigint")
    placed = topics.assign_versions(df, KEY, TopicParams(max_clips=5, min_clips=2))
    assert [r.topic_no for r in placed.orderBy("_place").collect()] == [1, 3, 5, 2, 4, 6]
    assert {r.version_no for r in placed.collect()} == {1}
    plan = topics.plan_versions(placed, KEY, TopicParams()).first()
    assert (plan.theme, plan.n_clips, plan.estimated_duration_s) == ("a、b", 6, 3.0)
