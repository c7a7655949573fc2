"""Queries over scores, reports and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.operators import audio, checks, scoring
from cueline.params import LATIN, LATIN_PUBLISHING
from cueline.plans import audit
from cueline.plans import fixtures as X
from cueline.plans import oracle as O
from cueline.plans import queries_audio as A
from cueline.plans import queries_checks as C
from cueline.plans.queries_checks import KEY, named
from cueline.plans.registry import query

TIMING_ISSUES = f"timing_issues as ({named(C.TIMING)})"
CONTENT_ISSUES = f"content_issues as ({named(C.CONTENT)})"
ALIGNMENT_ISSUES = f"alignment_issues as ({C.ALIGNMENT})"
BASE = (*C.BASE, *C.RULE_TABLES, O.SORTED)
ERRORS = ", ".join(O.quote(t) for t in scoring.CONTENT_ERROR_TYPES)

TIMING_SCORE = """
timing_score as (
  select transcript_id, total_entries, coalesce(c, 0) as critical_count, coalesce(w, 0) as warning_count,
    greatest(0.0, cast(100 - 15 * coalesce(c, 0) - 2 * coalesce(w, 0) as double)) as score, coalesce(c, 0) = 0 as passed
  from (select transcript_id, count(*) as total_entries from segments group by 1)
  left join (select transcript_id, count(*) filter (severity = 'critical') as c, count(*) filter (severity = 'warning') as w
    from timing_issues group by 1) using (transcript_id))"""
CONTENT_SCORE = f"""
content_score as (
  select *, cast((total_entries - errata_error_count) / total_entries * 100 as double) as accuracy_rate,
    critical_count = 0 and not ((total_entries - errata_error_count) / total_entries * 100 < 99.9 and errata_error_count > 0) as passed,
    greatest(0.0::double, 100 - critical_count * 15 - least(warning_count * 0.1::double, 15.0::double)) as score
  from (select transcript_id, total_entries, coalesce(c, 0) as critical_count, coalesce(w, 0) as warning_count, coalesce(e, 0) as errata_error_count
    from (select transcript_id, count(*) as total_entries from segments group by 1)
    left join (select transcript_id, count(*) filter (severity = 'critical') as c, count(*) filter (severity = 'warning') as w,
      count(*) filter (severity = 'critical' and issue_type in ({ERRORS})) as e from content_issues group by 1) using (transcript_id)))"""
COVERAGE = """
coverage as (
  select *, text_ms / span_ms as coverage_ratio, text_ms / total_segments as avg_segment_ms, total_chars / (text_ms / 1000) as chars_per_s
  from (select transcript_id, count(*) as total_segments, arg_max(end_ms, pos) - min(start_ms) as span_ms,
      cast(sum(end_ms - start_ms) as bigint) as text_ms, cast(sum(length(text)) as bigint) as total_chars
    from segments group by transcript_id))"""
ALIGNMENT_SCORE = f"""
alignment_parts as (
  select v.*, coalesce(c, 0) as critical_count,
    coalesce(w, 0) + (case when coverage_ratio < 0.85 then 1 else 0 end) + (case when chars_per_s > 8 or chars_per_s < 1 then 1 else 0 end) as warnings,
    least(100.0::double, coverage_ratio * 100) as coverage_score,
    greatest(0.0::double, 100 - coalesce(t, 0) * 5) as timing_accuracy_score,
    greatest(0.0::double, 100 - coalesce(n_over, 0) * 10 - coalesce(large, 0)) as continuity_score,
    case when n_over > 0 then valid / n_over * 100 else 100.0::double end as interruption_quality_score
  from coverage v
  left join (select transcript_id, count(*) filter (severity = 'critical') as c, count(*) filter (severity = 'warning') as w,
      count(*) filter (issue_type in ('timestamp_overlap', 'zero_or_negative_duration', 'subtitle_overlap')) as t
    from alignment_issues group by 1) using (transcript_id)
  left join (select transcript_id, count(*) filter (gap_ms < 0) as n_over, count(*) filter (gap_ms > 2000) as large,
      count(*) filter (gap_ms < 0 and ({C.INCOMPLETE} or {C.CONNECTIVE})) as valid from sorted group by 1) using (transcript_id)),
alignment_score as (
  select *, critical_count = 0 as passed,
    critical_count = 0 and warnings <= total_segments * 0.10 and alignment_score >= 85 and timing_accuracy_score >= 95
      and coverage_score >= 90 as publishing_ready
  from (select *, coverage_score * 0.20::double + timing_accuracy_score * 0.35::double + continuity_score * 0.15::double
      + interruption_quality_score * 0.15::double + (100 - least(100, critical_count * 5)) * 0.15::double as alignment_score
    from alignment_parts))"""


@query("severity_rollup", O.with_(*BASE, TIMING_ISSUES) + """
select transcript_id, count(*) filter (severity = 'critical') as critical_count, count(*) filter (severity = 'warning') as warning_count,
  count(*) filter (severity = 'info') as info_count from timing_issues group by transcript_id""")
def severity_rollup(spark, sf):
    return scoring.severity_rollup(C.found(spark, sf, C.timing(spark)), KEY)


@query("issue_histogram", O.with_(*BASE, CONTENT_ISSUES) + "select severity, issue_type, count(*) as n from content_issues group by all")
def issue_histogram(spark, sf):
    return scoring.issue_histogram(C.found(spark, sf, C.content(spark)))


@query("issue_types", O.with_(*BASE, CONTENT_ISSUES) + "select distinct transcript_id, issue_type from content_issues")
def issue_types(spark, sf):
    return C.found(spark, sf, C.content(spark)).select("transcript_id", "issue_type").distinct()


@query("issue_previews", O.with_(*BASE, TIMING_ISSUES) + """
select transcript_id, entry_index, issue_type from timing_issues where issue_type in ('duration_too_short', 'duration_too_long')
qualify row_number() over (partition by transcript_id order by entry_index) <= 5""")
def issue_previews(spark, sf):
    rows = C.found(spark, sf, checks.display_duration(LATIN))
    return scoring.previews(rows, KEY, 5, [F.col("entry_index")]).select("transcript_id", "entry_index", "issue_type")


@query("all_issues", O.with_(*BASE, TIMING_ISSUES, CONTENT_ISSUES, ALIGNMENT_ISSUES) + """
select 'timing' as source, transcript_id, issue_type, count(*) as n from timing_issues group by all
union all select 'content', transcript_id, issue_type, count(*) from content_issues group by all
union all select 'alignment', transcript_id, issue_type, count(*) from alignment_issues group by all""")
def all_issues(spark, sf):
    rows = audit.all_issues(C.entries(spark, sf), C.sorted_rows(spark, sf), KEY, LATIN, LATIN_PUBLISHING, C.latin_rules(spark))
    return rows.groupBy("source", "transcript_id", "issue_type").agg(F.count(F.lit(1)).alias("n"))


_PLAIN = "select transcript_id, total_entries, critical_count, warning_count, score, passed"


@query("timing_scores", O.with_(*BASE, TIMING_ISSUES, TIMING_SCORE) + _PLAIN + " from timing_score")
def timing_scores(spark, sf):
    return scoring.timing_score(C.entries(spark, sf), KEY, checks.timing_family(LATIN, C.latin_rules(spark), places=False))


@query("content_scores", O.with_(*BASE, CONTENT_ISSUES, CONTENT_SCORE) + _PLAIN + ", errata_error_count, accuracy_rate from content_score")
def content_scores(spark, sf):
    return scoring.content_score(C.entries(spark, sf), KEY, checks.content_family(LATIN, C.latin_rules(spark), places=False))


@query("coverage", O.with_(O.SEGMENTS, COVERAGE) + "select * from coverage")
def coverage(spark, sf):
    return scoring.coverage(X.segments(spark, sf), KEY)


@query("coverage_issues", O.with_(O.SEGMENTS, COVERAGE) + """
select transcript_id, 'low_coverage' as issue_type, 'warning' as severity, coverage_ratio as value from coverage where coverage_ratio < 0.85
union all select transcript_id, 'text_too_dense', 'warning', chars_per_s from coverage where chars_per_s > 8
union all select transcript_id, 'text_too_sparse', 'warning', chars_per_s from coverage where chars_per_s < 1""")
def coverage_issues(spark, sf):
    return scoring.coverage(X.segments(spark, sf), KEY).select("transcript_id", F.inline(scoring.coverage_issues())).drop("detail")


@query("alignment_reports", O.with_(*BASE, ALIGNMENT_ISSUES, COVERAGE, ALIGNMENT_SCORE) + """
select transcript_id, total_segments, critical_count, warnings as warning_count, coverage_score, timing_accuracy_score, continuity_score,
  interruption_quality_score, alignment_score, passed, publishing_ready from alignment_score""")
def alignment_reports(spark, sf):
    family = checks.alignment_family(LATIN, LATIN_PUBLISHING)
    return scoring.alignment_report(C.sorted_rows(spark, sf), KEY, family, LATIN)


ITERATION = """
iteration as (
  select transcript_id, c.score as content_score, t.score as timing_score, a.alignment_score, accuracy_rate, c.passed as content_passed,
    t.passed as timing_passed, a.passed as alignment_passed, publishing_ready,
    c.score * 0.40::double + a.alignment_score * 0.35::double + t.score * 0.25::double as total_score,
    c.critical_count + t.critical_count + a.critical_count as critical_issues,
    c.warning_count + t.warning_count + a.warnings as warnings,
    c.passed and t.passed and a.passed and c.critical_count + t.critical_count + a.critical_count = 0 as all_passed
  from content_score c join timing_score t using (transcript_id) join alignment_score a using (transcript_id))"""
AUDIT = (*BASE, TIMING_ISSUES, CONTENT_ISSUES, ALIGNMENT_ISSUES, TIMING_SCORE, CONTENT_SCORE, COVERAGE, ALIGNMENT_SCORE, ITERATION)


def iteration(spark, sf):
    return audit.single_iteration(C.entries(spark, sf), C.sorted_rows(spark, sf), KEY, LATIN, LATIN_PUBLISHING, C.latin_rules(spark))


@query("combined_audit", O.with_(*AUDIT) + "select * from iteration")
def combined_audit(spark, sf):
    return iteration(spark, sf)


LOUD_ISSUES = """
loud_issues as (
  select file_id, 'loudness_out_of_range' as issue_type, 'warning' as severity, lufs as value from loudness where abs(lufs + 14) > 2
  union all select file_id, 'true_peak_exceeded', 'critical', true_peak from loudness where true_peak > -1
  union all select file_id, 'lra_too_high', 'warning', lra from loudness where lra > 10)"""
AUDIO_ISSUES = f"""{A.EDGE.strip()},
audio_issues as (
  select file_id, issue_type, severity, value from loud_issues
  union all select file_id, issue_type, severity, edge_db from ({A.EDGES}))"""
AUDIO_SCORE = """
audio_score as (
  select l.file_id, case when l.file_id % 10 = 7 then 1 else coalesce(c, 0) end as critical_count,
    case when l.file_id % 10 = 7 then 0 else coalesce(w, 0) end as warning_count,
    case when l.file_id % 10 = 7 then 0.0::double else greatest(0.0::double, 100 - 15 * coalesce(c, 0) - 3 * coalesce(w, 0)) end as score,
    l.file_id % 10 <> 7 and coalesce(c, 0) = 0 as passed
  from loudness l left join (select file_id, count(*) filter (severity = 'critical') as c, count(*) filter (severity = 'warning') as w
    from audio_issues group by file_id) i on l.file_id = i.file_id)"""


def loud_issues(spark, sf):
    return X.loudness(spark, sf).select("file_id", F.inline(checks.loudness_compliance())).drop("detail")


def audio_issues_of(spark, sf):
    return audio.file_issues(X.loudness(spark, sf), A.heard_frames(spark, sf), ["file_id"])


def audio_scores_of(spark, sf):
    files = X.loudness(spark, sf).select("file_id", (F.col("file_id") % 10 != 7).alias("present"))
    return scoring.audio_score(audio_issues_of(spark, sf), files)


@query("loudness_issues", O.with_(O.LOUDNESS, LOUD_ISSUES) + "select * from loud_issues")
def loudness_issues(spark, sf):
    return loud_issues(spark, sf)


@query("loudness_issues_by_platform", O.with_(O.LOUDNESS) + """,
targets(platform, target) as (values ('bilibili', -14.0::double), ('xiaoyuzhou', -16.0::double))
select file_id, platform, 'loudness_out_of_range' as issue_type, lufs as value from loudness, targets where abs(lufs - target) > 2
union all select file_id, platform, 'true_peak_exceeded', true_peak from loudness, targets where true_peak > -1
union all select file_id, platform, 'lra_too_high', lra from loudness, targets where lra > 10""")
def loudness_issues_by_platform(spark, sf):
    rows = audio.platform_fan_out(X.loudness(spark, sf).withColumnRenamed("true_peak", "_peak"), ["bilibili", "xiaoyuzhou"])
    rows = rows.withColumnsRenamed({"true_peak": "peak_limit", "_peak": "true_peak"})
    family = checks.loudness_compliance(target=F.col("target_lufs"), true_peak=F.col("peak_limit"))
    return rows.select("file_id", "platform", F.inline(family)).drop("severity", "detail")


@query("audio_file_issues", O.with_(O.LOUDNESS, O.FRAMES, LOUD_ISSUES, AUDIO_ISSUES) + "select * from audio_issues")
def audio_file_issues(spark, sf):
    return audio_issues_of(spark, sf)


_SOUND = (O.LOUDNESS, O.FRAMES, LOUD_ISSUES, AUDIO_ISSUES, AUDIO_SCORE)


@query("audio_scores", O.with_(*_SOUND) + "select * from audio_score")
def audio_scores(spark, sf):
    return audio_scores_of(spark, sf)


_BY_TRANSCRIPT = """
sound as (select file_id as transcript_id, sum(score) / count(*) as audio_score, bool_and(passed) as apass,
  cast(sum(critical_count) as bigint) as acrit from audio_score group by 1)"""


def audio_by_transcript(spark, sf):
    return audio_scores_of(spark, sf).withColumnRenamed("file_id", "transcript_id")


@query("full_validation", O.with_(*AUDIT, *_SOUND, _BY_TRANSCRIPT) + """
select transcript_id, content_score * 0.30::double + timing_score * 0.20::double + alignment_score * 0.25::double
    + coalesce(audio_score, 0) * 0.25::double as overall_score,
  content_passed and timing_passed and alignment_passed and coalesce(apass, true) and critical_issues + coalesce(acrit, 0) = 0 as all_passed,
  critical_issues + coalesce(acrit, 0) as total_critical_issues
from iteration left join sound using (transcript_id)""")
def full_validation(spark, sf):
    return scoring.full_validation(iteration(spark, sf), audio_by_transcript(spark, sf), KEY)


_TEXT = dict(scoring.FULL_VALIDATION_TEXTS)


@query("full_validation_advice", O.with_(*AUDIT) + f""",
kinds as (select transcript_id, list(distinct issue_type) as kinds from content_issues where severity = 'critical' group by 1),
advice as (select transcript_id, list_filter([
    case when not content_passed and list_contains(kinds, 'traditional_chinese_detected') then '{_TEXT["traditional_chinese_detected"]}' end,
    case when not content_passed and list_contains(kinds, 'errata_violation') then '{_TEXT["errata_violation"]}' end,
    case when not content_passed and list_contains(kinds, 'multi_line_subtitle') then '{_TEXT["multi_line_subtitle"]}' end,
    case when not timing_passed then '{_TEXT["timing"]}' end,
    case when not publishing_ready then '{_TEXT["alignment"]}' end], lambda x: x is not null) as found
  from iteration left join kinds using (transcript_id))
select transcript_id, case when len(found) > 0 then array_to_string(found, '|') else '{_TEXT["clear"]}' end as recommendations from advice""")
def full_validation_advice(spark, sf):
    rows = scoring.full_validation_advice(C.found(spark, sf, C.content(spark)), iteration(spark, sf), KEY)
    return rows.withColumn("recommendations", F.array_join("recommendations", "|"))


# -- version reports ------------------------------------------------------------------

_VERSION = "'v' || transcript_id"
_SUMMARIES = """
summaries as (select 'v' || o_custkey as version_key, o_orderkey % 5 as generated,
  case when o_orderkey % 7 = 2 then 0 else o_orderkey % 3 end as skipped from orders)"""
EFFICIENCY = """
efficiency as (
  select version_key, g as total_generated, s as total_skipped, s / (g + s) as skip_ratio,
    case when g > 0 and s = 0 then 100.0::double else least(100.0::double, s / (g + s) * 100 + 50) end as efficiency_score
  from (select version_key, cast(sum(generated) as bigint) as g, cast(sum(skipped) as bigint) as s from summaries group by 1) where g + s > 0)"""


def efficiency_rows(spark, sf):
    o = F.col("o_orderkey")
    rows = X.table(spark, sf, "orders").select(
        F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("version_key"), (o % 5).alias("generated"),
        F.when(o % 7 == 2, 0).otherwise(o % 3).alias("skipped"),
    )
    return scoring.efficiency(rows, ["version_key"])


@query("efficiency", O.with_(_SUMMARIES, EFFICIENCY) + "select * from efficiency")
def efficiency(spark, sf):
    return efficiency_rows(spark, sf)


_STYLE_FILES = """
style_files as (
  select 'v' || transcript_id as version_key, transcript_id,
    '[Script Info]' || chr(10) || (case when transcript_id % 2 = 0 then 'ScaledBorderAndShadow: yes' else '' end)
    || (case when transcript_id % 70 < 60 then 'Style: A,Noto Sans SC,60' else 'Style: A,Arial,60' end)
    || (case transcript_id % 3 when 0 then 'BorderStyle,3' when 1 then '{\\p1}\\1c&H00\\1a&H80' else '' end) as content
  from (select distinct transcript_id from segments))"""
STYLE = """
style as (
  select version_key, greatest(0.0::double, 95 - sum(
    (case when contains(content, 'BorderStyle,3') or (contains(content, '\\p1}') and contains(content, '\\1c&H') and contains(content, '\\1a&H')) then 0 else 5 end)
    + (case when contains(content, 'Noto Sans SC') then 0 else 10 end)
    + (case when contains(content, 'ScaledBorderAndShadow') then 0 else 5 end))) as style_score
  from style_files group by version_key)"""


def style_rows(spark, sf):
    t = F.col("transcript_id")
    content = F.concat(
        F.lit("[Script Info]\n"), F.when(t % 2 == 0, "ScaledBorderAndShadow: yes").otherwise(""),
        F.when(t % 70 < 60, "Style: A,Noto Sans SC,60").otherwise("Style: A,Arial,60"),
        F.when(t % 3 == 0, "BorderStyle,3").when(t % 3 == 1, "{\\p1}\\1c&H00\\1a&H80").otherwise(""),
    )
    files = X.segments(spark, sf).select("transcript_id").distinct()
    return scoring.style_deductions(
        files.select(F.concat(F.lit("v"), t.cast("string")).alias("version_key"), content.alias("content")), ["version_key"]
    )


@query("style_scores", O.with_(O.SEGMENTS, _STYLE_FILES, STYLE) + "select * from style")
def style_scores(spark, sf):
    """One style file per version."""
    return style_rows(spark, sf)


_PER_FILE = f"""
af as (select 'v' || file_id as version_key, sum(score) / count(*) as audio, sum(critical_count) as ac, sum(warning_count) as aw from audio_score group by 1),
tf as (select {_VERSION} as version_key, sum(score) / count(*) as timing, sum(critical_count) as tc, sum(warning_count) as tw from timing_score group by 1),
cf as (select {_VERSION} as version_key, sum(score) / count(*) as content, sum(critical_count) as cc, sum(warning_count) as cw from content_score group by 1),
pen as (select {_VERSION} as version_key, count(*) as n_penalties from segments where length(text) < 12 group by 1)"""
REPORT = """
report as (
  select *, critical_count = 0 and overall_score >= 80 as passed from (
    select version_key, coalesce(audio, 100.0) as audio_score, coalesce(timing, 100.0) as timing_score, coalesce(content, 100.0) as content_score,
      coalesce(style_score, 0.0) as style_score, coalesce(efficiency_score, 100.0) as efficiency_score,
      case when n_penalties > 0 then greatest(0.0, base - least(10, n_penalties * 2)) else base end as overall_score,
      cast(coalesce(ac, 0) + coalesce(tc, 0) + coalesce(cc, 0) as bigint) as critical_count,
      cast(coalesce(aw, 0) + coalesce(tw, 0) + coalesce(cw, 0) as bigint) as warning_count
    from (select *, coalesce(audio, 100.0) * 0.25::double + (coalesce(timing, 100.0) * 0.4::double + coalesce(content, 100.0) * 0.6::double) * 0.25::double
        + coalesce(style_score, 0.0) * 0.20::double + coalesce(efficiency_score, 100.0) * 0.20::double as base
      from (select 'v' || file_id as version_key from loudness) left join af using (version_key) left join tf using (version_key)
      left join cf using (version_key) left join style using (version_key) left join efficiency using (version_key) left join pen using (version_key))))"""
REPORT_BASE = (*AUDIT, *_SOUND, _SUMMARIES, EFFICIENCY, _STYLE_FILES, STYLE, _PER_FILE, REPORT)


def version(df, column="transcript_id"):
    """A transcript, an audio file and a customer of the same number form one version."""
    return df.withColumn("version_key", F.concat(F.lit("v"), F.col(column).cast("string")))


def reports(spark, sf):
    audio_files = version(audio_scores_of(spark, sf), "file_id")
    versions = audio_files.select("version_key").distinct()
    short = X.segments(spark, sf).where(F.length("text") < 12)
    return scoring.quality_report(
        versions, ["version_key"], audio_files, version(timing_scores(spark, sf)), version(content_scores(spark, sf)),
        style_rows(spark, sf), efficiency_rows(spark, sf), version(short).groupBy("version_key").agg(F.count(F.lit(1)).alias("n_penalties")),
    )


@query("quality_reports", O.with_(*REPORT_BASE) + "select * from report")
def quality_reports(spark, sf):
    return reports(spark, sf)


def _kinds(types) -> str:
    return "(" + ", ".join(O.quote(t) for t in types) + ")"


_REPORT_ISSUES = f"""
report_issues as (
  select {_VERSION} as version_key, issue_type, severity from timing_issues
  union all select {_VERSION}, issue_type, severity from content_issues where severity in ('critical', 'warning')
  union all select 'v' || file_id, issue_type, severity from audio_issues)"""


def report_issues(spark, sf):
    timing = version(C.found(spark, sf, C.timing(spark))).select("version_key", "issue_type", "severity")
    content = version(C.found(spark, sf, C.content(spark))).where(F.col("severity").isin("critical", "warning"))
    sound = version(audio_issues_of(spark, sf), "file_id")
    return timing.unionByName(content.select(*timing.columns)).unionByName(sound.select(*timing.columns))


METRICS = f"""
n as (select {_VERSION} as version_key, count(*) as total_entries from segments group by 1),
m as (select version_key,
  count(*) filter (severity = 'critical') as critical_issue_count, count(*) filter (severity = 'warning') as warning_count,
  count(*) filter (issue_type in ('duration_too_short', 'duration_too_long')) as subtitle_timing_violations,
  count(*) filter (issue_type in ('reading_speed_too_fast', 'reading_speed_fast')) as subtitle_reading_speed_violations,
  count(*) filter (issue_type = 'line_too_long') as subtitle_line_length_violations,
  count(*) filter (issue_type in ('overlap', 'subtitle_overlap')) as subtitle_overlap_count,
  count(*) filter (issue_type like 'word_level_%' and issue_type <> 'word_level_filler_sound') as word_level_error_count,
  count(*) filter (issue_type in {_kinds(scoring.ERRATA_TYPES)}) as subtitle_errata_violations,
  count(*) filter (issue_type = 'true_peak_exceeded') as audio_tp_violations,
  count(*) filter (issue_type = 'abrupt_start') as audio_abrupt_start_count, count(*) filter (issue_type = 'abrupt_end') as audio_abrupt_end_count,
  count(*) filter (issue_type in {_kinds(scoring.TRUNCATION_TYPES)}) as tr, count(*) filter (issue_type in {_kinds(scoring.MULTILINE_TYPES)}) as ml,
  count(*) filter (issue_type in {_kinds(scoring.FILLER_TYPES)}) as fi, count(*) filter (issue_type in {_kinds(scoring.FRAGMENT_TYPES)}) as subtitle_fragment_count
  from report_issues group by 1),
am as (select 'v' || file_id as version_key, sum(score) / count(*) as audio_quality_score, sum(abs(lufs + 14)) / count(*) as audio_lufs_deviation
  from audio_score join loudness using (file_id) group by 1),
metrics as (select version_key, critical_issue_count, warning_count, subtitle_timing_violations, subtitle_reading_speed_violations,
  subtitle_line_length_violations, subtitle_overlap_count, word_level_error_count, subtitle_errata_violations, audio_tp_violations,
  audio_abrupt_start_count, audio_abrupt_end_count, subtitle_fragment_count, coalesce(audio_quality_score, 0) as audio_quality_score,
  coalesce(audio_lufs_deviation, 0) as audio_lufs_deviation,
  round_even((total_entries - tr) / total_entries * 100, 1) as subtitle_semantic_completeness,
  round_even((total_entries - ml) / total_entries * 100, 1) as subtitle_multiline_compliance,
  round_even((total_entries - fi) / total_entries * 100, 1) as subtitle_filler_cleanup_score, coalesce(style_score, 0) as subtitle_style_score,
  coalesce(style_score, 100) as subtitle_visual_bounds_score, case when coalesce(style_score, 0) > 80 then 90 else 60 end as subtitle_font_size_score,
  coalesce(al.alignment_score, 0) as alignment_score, coalesce(al.coverage_score, 0) as alignment_coverage_score,
  coalesce(al.timing_accuracy_score, 0) as alignment_timing_accuracy, coalesce(al.continuity_score, 0) as alignment_continuity_score,
  coalesce(efficiency_score, 0) as generation_efficiency_score, coalesce(loud.passed, true) as loudness_normalization_pass,
  coalesce(loud.deviation, 0) as loudness_lufs_deviation
from n left join m using (version_key) left join am using (version_key) left join style using (version_key)
  left join (select 'v' || transcript_id as version_key, alignment_score, coverage_score, timing_accuracy_score, continuity_score from alignment_score) al using (version_key)
  left join efficiency using (version_key)
  left join (select 'v' || file_id as version_key, bool_and(abs(lufs + 14) <= 1) as passed, max(abs(lufs + 14)) as deviation from loudness group by 1) loud using (version_key))"""


@query("report_metrics", O.with_(*REPORT_BASE, _REPORT_ISSUES, METRICS) + "select * from metrics")
def report_metrics(spark, sf):
    return metrics_of(spark, sf)


def metrics_of(spark, sf):
    entries = version(X.segments(spark, sf)).groupBy("version_key").agg(F.count(F.lit(1)).alias("total_entries"))
    sound = version(audio_scores_of(spark, sf).join(X.loudness(spark, sf), "file_id"), "file_id")
    off = F.abs(F.col("lufs") + 14)
    loud = version(X.loudness(spark, sf), "file_id").groupBy("version_key").agg(
        F.bool_and(off <= 1).alias("loudness_passed"), F.max(off).alias("loudness_deviation")
    )
    parts = [version(alignment_reports(spark, sf)), efficiency_rows(spark, sf), loud]
    return scoring.report_metrics(report_issues(spark, sf), entries, sound, style_rows(spark, sf), ["version_key"], parts)


_ADVICE = dict(scoring.RECOMMENDATIONS)


@query("recommendations", O.with_(*REPORT_BASE, _REPORT_ISSUES) + f""",
errata as (select {_VERSION} as version_key, count(*) as errata_violations from content_issues where severity in ('critical', 'warning') group by 1),
flags as (select version_key,
  bool_or(severity = 'critical' and issue_type in ('loudness_out_of_range', 'true_peak_exceeded')) as loud,
  bool_or(issue_type in ('abrupt_start', 'abrupt_end')) as abrupt,
  bool_or(severity in ('critical', 'warning') and issue_type in ('duration_too_short', 'overlap', 'reading_speed_too_fast')) as tim,
  bool_or(severity in ('critical', 'warning')) as any_found from report_issues group by 1)
select version_key, array_to_string(list_filter([
  case when loud then '{_ADVICE["loudness"]}' end, case when abrupt then '{_ADVICE["abrupt"]}' end, case when tim then '{_ADVICE["timing"]}' end,
  case when not coalesce(any_found, false) then '{_ADVICE["clear"]}' end, case when errata_violations > 0 then '{_ADVICE["errata"]}' end,
  case when style_score < 90 then '{_ADVICE["style"]}' end, case when efficiency_score < 90 then '{_ADVICE["efficiency"]}' end],
  lambda x: x is not null), '|') as recommendations
from report left join flags using (version_key) left join errata using (version_key)""")
def recommendations(spark, sf):
    content = version(C.found(spark, sf, C.content(spark))).where(F.col("severity").isin("critical", "warning"))
    errata = content.groupBy("version_key").agg(F.count(F.lit(1)).alias("errata_violations"))
    rows = reports(spark, sf).join(errata, "version_key", "left").withColumn("errata_violations", F.coalesce("errata_violations", F.lit(0)))
    advice = scoring.recommendations(report_issues(spark, sf), rows, ["version_key"])
    return advice.withColumn("recommendations", F.array_join("recommendations", "|"))


# -- scorecards -----------------------------------------------------------------------

_ITEMS = ("resolution", "codec", "loudness", "accuracy", "simplified", "sync", "facts", "hook")
_WEIGHTS = ((8.0, False), (5.0, False), (8.0, False), (10.0, True), (10.0, True), (8.0, True), (4.0, True), (4.0, False))
_ITEM_ROWS = ", ".join(f"({i}, '{n}', {w}::double, {str(v).lower()})" for i, (n, (w, v)) in enumerate(zip(_ITEMS, _WEIGHTS)))


@query("weighted_scorecard", f"""
with weights(item_no, item, weight, veto) as (values {_ITEM_ROWS}),
checks as (select l_orderkey % 500 as version_key, l_partkey % 8 as item_no, cast(l_quantity * 2 as double) as score,
  case when l_linenumber = 1 and l_suppkey % 50 = 0 then 'veto' when l_suppkey % 40 = 1 then 'major' when l_quantity < 3 then 'minor' end as level from lineitem),
agg as (select version_key, sum(score * weight) / sum(weight) as total_score, bool_or(level is not null and (veto or level = 'veto')) as vetoed,
  count(*) filter (level = 'major') as majors from checks join weights using (item_no) group by 1)
select *, case when vetoed or total_score < 70 then 'fail' when total_score >= 85 then 'pass' else 'conditional' end as verdict,
  vetoed or majors > 0 as retry from agg""")
def weighted_scorecard(spark, sf):
    items = F.array(*map(F.lit, _ITEMS))
    rows = X.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("version_key"), F.get(items, (F.col("l_partkey") % 8).cast("int")).alias("item"),
        (F.col("l_quantity") * 2).cast("double").alias("score"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_suppkey") % 50 == 0), "veto")
        .when(F.col("l_suppkey") % 40 == 1, "major").when(F.col("l_quantity") < 3, "minor").alias("level"),
    )
    weights = spark.createDataFrame([(n, w, v) for n, (w, v) in zip(_ITEMS, _WEIGHTS)], "item string, weight double, veto boolean")
    return scoring.weighted_scorecard(rows, weights, ["version_key"])


_SCENARIOS = """
scenarios as (
  select o_custkey % 50 as run_id, o_orderkey as scenario_id, o_orderkey % 5 <> 0 as workflow_selection_correct,
    cast(60 + o_orderkey % 41 as double) as parameter_compliance, cast(50 + o_custkey % 51 as double) as output_completeness,
    cast(70 + o_orderkey % 31 as double) as quality_compliance from orders),
delivered as (select *, (case when workflow_selection_correct then 100.0::double else 0.0::double end) * 0.25::double
  + parameter_compliance * 0.20::double + output_completeness * 0.30::double + quality_compliance * 0.25::double as delivery_score from scenarios)"""


def scenarios(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = X.table(spark, sf, "orders").select(
        (c % 50).alias("run_id"), o.alias("scenario_id"), (o % 5 != 0).alias("workflow_selection_correct"),
        (60 + o % 41).cast("double").alias("parameter_compliance"), (50 + c % 51).cast("double").alias("output_completeness"),
        (70 + o % 31).cast("double").alias("quality_compliance"),
    )
    return scoring.scenario_scores(rows)


@query("scenario_scores", O.with_(_SCENARIOS) + "select run_id, scenario_id, delivery_score from delivered")
def scenario_scores(spark, sf):
    return scenarios(spark, sf).select("run_id", "scenario_id", "delivery_score")


_ROLLUP = """
select {key}, count(*) filter (workflow_selection_correct) / count(*) * 100 as workflow_selection_accuracy,
  round(avg(parameter_compliance), 6) as parameter_compliance, round(avg(output_completeness), 6) as output_completeness,
  round(avg(quality_compliance), 6) as quality_compliance, round(avg(delivery_score), 6) as delivery_score,
  count(*) as scenario_count, count(*) filter (delivery_score >= 80) as scenarios_passed,
  count(*) filter (workflow_selection_correct) / count(*) * 100 >= 80 and avg(delivery_score) >= 75
    and count(*) filter (delivery_score >= 80) >= count(*) * 0.8 as passed
from {source} group by 1"""
_MEANS = ("parameter_compliance", "output_completeness", "quality_compliance", "delivery_score")


@query("scenario_rollup", O.with_(_SCENARIOS) + _ROLLUP.format(key="run_id", source="delivered"))
def scenario_rollup(spark, sf):
    rows = scoring.scenario_rollup(scenarios(spark, sf), ["run_id"])
    return rows.withColumns({c: F.round(c, 6) for c in _MEANS})


@query("scenario_comparison", O.with_(_SCENARIOS) + """,
b as (select run_id, count(*) as n, avg(delivery_score) as d, count(*) filter (delivery_score >= 80) as p from delivered where scenario_id % 2 = 0 group by 1),
a as (select run_id, count(*) as n, avg(delivery_score) as d, count(*) filter (delivery_score >= 80) as p from delivered where scenario_id % 2 = 1 group by 1)
select run_id, a.d > b.d as improved, a.d < b.d as regressed, cast(a.p - b.p as bigint) as scenarios_passed_delta from a join b using (run_id)""")
def scenario_comparison(spark, sf):
    rows = scenarios(spark, sf)
    half = lambda odd: scoring.scenario_rollup(rows.where(F.col("scenario_id") % 2 == odd), ["run_id"])
    return scoring.scenario_comparison(half(0), half(1), ["run_id"]).select("run_id", "improved", "regressed", "scenarios_passed_delta")
