"""Queries over experiment trials, logs and recommendations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cueline.operators import experiments
from cueline.params import LATIN
from cueline.plans import fixtures as X
from cueline.plans import jobs
from cueline.plans import oracle as O
from cueline.plans import queries_checks as C
from cueline.plans import queries_scores as S
from cueline.plans.registry import query

KEY = ["series_id"]
COMPARED = """
lagged as (select *, lag(overall_score) over w as bs, lag(critical_count) over w as bc, lag(fragment_count) over w as bf, lag(passed) over w as bp
  from experiments window w as (partition by series_id order by pos)),
compared as (
  select series_id, experiment_id, pos, overall_score, overall_score - bs as overall_score_delta, critical_count - bc as critical_count_delta,
    fragment_count - bf as fragment_count_delta,
    (passed and not bp) or overall_score - bs >= 0.5 or (abs(overall_score - bs) < 0.5 and critical_count < bc)
      or (fragment_count < bf and overall_score >= bs - 0.1) as improved,
    (bp and not passed) or overall_score - bs < 0 as regressed, bp as passed_before, passed from lagged)"""


def compared(spark, sf):
    return experiments.compare_with_previous(X.ordered_experiments(spark, sf), KEY)


@query("trial_comparison", O.with_(O.EXPERIMENTS, COMPARED) + """
select series_id, experiment_id, overall_score_delta, critical_count_delta, fragment_count_delta, improved, regressed, passed_before from compared""")
def trial_comparison(spark, sf):
    return compared(spark, sf).select(
        "series_id", "experiment_id", "overall_score_delta", "critical_count_delta", "fragment_count_delta", "improved", "regressed", "passed_before"
    )


def records(spark, sf):
    rows = compared(spark, sf)
    return rows.withColumns({"compared": F.col("passed_before").isNotNull(), "kept": F.col("improved")})


@query("experiment_summary", O.with_(O.EXPERIMENTS, COMPARED) + """
select series_id, count(*) as total_experiments, count(*) filter (improved) as improvements,
  count(*) filter (not coalesce(improved, false) and passed_before is not null) as regressions, count(*) filter (improved) as kept_changes,
  count(*) - count(*) filter (improved) as discarded_changes, count(*) filter (improved) / greatest(1, count(*)) * 100 as improvement_rate
from compared group by series_id""")
def experiment_summary(spark, sf):
    return experiments.experiment_summary(records(spark, sf), KEY)


@query("improvements", O.with_(O.EXPERIMENTS, COMPARED) + "select series_id, experiment_id from compared where improved")
def improvements(spark, sf):
    return records(spark, sf).where("improved").select("series_id", "experiment_id")


@query("latest_experiment", O.with_(O.EXPERIMENTS) + """
select series_id, arg_max(experiment_id, pos) as experiment_id, arg_max(overall_score, pos) as overall_score from experiments group by series_id""")
def latest_experiment(spark, sf):
    return experiments.latest_record(X.experiments(spark, sf), KEY, ["ts", "experiment_id"], ["experiment_id", "overall_score"])


@query("best_so_far", O.with_(O.EXPERIMENTS) + """,
b as (select *, max(overall_score) over (partition by series_id order by pos rows between unbounded preceding and 1 preceding) as best_before from experiments),
i as (select *, overall_score > coalesce(best_before, 0) as improved from b),
l as (select *, max(case when improved then pos end) over (partition by series_id order by pos) as last_at from i),
d as (select *, case when last_at is null then pos + 1 else pos - last_at end as idle from l)
select series_id, experiment_id, best_before, improved, case when idle > 0 then (idle - 1) % 5 + 1 else 0 end as stagnation,
  (case when idle > 0 then (idle - 1) % 5 + 1 else 0 end) = 5 as escalate from d""")
def best_so_far(spark, sf):
    rows = experiments.best_so_far(X.ordered_experiments(spark, sf), KEY)
    return rows.select("series_id", "experiment_id", "best_before", "improved", "stagnation", "escalate")


_HALVES = """
before_t as (select o_custkey as run_id, max(cast(o_orderkey % 41 as double)) + 60 as s, min(o_orderkey % 7) as c, min(o_orderkey % 5) as f, bool_or(o_orderkey % 7 = 0) as p
  from orders where o_orderstatus = 'F' group by 1),
after_t as (select o_custkey as run_id, max(cast(o_orderkey % 41 as double)) + 60 as s, min(o_orderkey % 7) as c, min(o_orderkey % 5) as f, bool_or(o_orderkey % 7 = 0) as p
  from orders where o_orderstatus <> 'F' group by 1)"""


@query("metric_comparison", O.with_(_HALVES) + """
select run_id, a.s - b.s as overall_score_delta, cast(a.c - b.c as double) as critical_issue_count_delta,
  (a.p and not b.p) or a.s - b.s >= 0.5 or (abs(a.s - b.s) < 0.5 and a.c < b.c) or (a.f < b.f and a.s >= b.s - 0.1) as improved,
  (b.p and not a.p) or a.s < b.s as regressed, b.p as passed_before, a.p as passed_after
from before_t b join after_t a using (run_id)""")
def metric_comparison(spark, sf):
    orders, o = X.table(spark, sf, "orders"), F.col("o_orderkey")

    def half(condition):
        return orders.where(condition).groupBy(F.col("o_custkey").alias("run_id")).agg(
            (F.max((o % 41).cast("double")) + 60).alias("overall_score"), F.min(o % 7).alias("critical_issue_count"),
            F.min(o % 5).alias("subtitle_fragment_count"), F.bool_or(o % 7 == 0).alias("passed"),
        )

    return experiments.compare_metrics(
        half("o_orderstatus = 'F'"), half("o_orderstatus <> 'F'"), ["run_id"], ["overall_score", "critical_issue_count"]
    )


_METRICS = """
metrics as (select o_orderkey as run_id, o_orderkey % 3 as audio_abrupt_start_count, o_custkey % 2 as audio_abrupt_end_count,
  o_orderkey % 5 as critical_issue_count, o_custkey % 4 as subtitle_overlap_count, cast(60 + o_orderkey % 41 as double) as subtitle_style_score,
  cast(o_custkey % 101 as double) as subtitle_semantic_completeness from orders)"""


@query("strategy_recommendations", O.with_(_METRICS) + """,
hits as (
  select run_id, 1 as k, 'improve_cut_points' as strategy from metrics where audio_abrupt_start_count > 0 or audio_abrupt_end_count > 0
  union all select run_id, 2, 'improve_crossfade' from metrics where audio_abrupt_start_count > 0 or audio_abrupt_end_count > 0
  union all select run_id, 3, 'improve_topic_segmentation' from metrics where critical_issue_count > 3
  union all select run_id, 4, 'zero_tolerance_subtitle_overlap' from metrics where subtitle_overlap_count > 0
  union all select run_id, 5, 'improve_subtitle_frosted_glass' from metrics where subtitle_style_score < 90
  union all select run_id, 6, 'improve_subtitle_semantic_segmentation' from metrics where subtitle_semantic_completeness < 80
  union all select run_id, 7, 'improve_subtitle_multiline' from metrics where subtitle_semantic_completeness < 80)
select run_id, row_number() over (partition by run_id order by k) - 1 as ord, strategy from hits""")
def strategy_recommendations(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    metrics = X.table(spark, sf, "orders").select(
        o.alias("run_id"), (o % 3).alias("audio_abrupt_start_count"), (c % 2).alias("audio_abrupt_end_count"),
        (o % 5).alias("critical_issue_count"), (c % 4).alias("subtitle_overlap_count"),
        (60 + o % 41).cast("double").alias("subtitle_style_score"), (c % 101).cast("double").alias("subtitle_semantic_completeness"),
    )
    # A run that measures some metrics only; rules on the others can't fire.
    unmeasured = [
        "alignment_score", "audio_tp_violations", "generation_efficiency_score", "loudness_lufs_deviation", "loudness_normalization_pass",
        "subtitle_errata_violations", "subtitle_filler_cleanup_score", "subtitle_font_size_score", "subtitle_fragment_count",
        "subtitle_reading_speed_violations", "subtitle_style_extraction_score", "subtitle_timing_violations", "subtitle_visual_bounds_score",
        "vertical_overlay_aspect_compliant", "vertical_style_completeness", "word_level_error_count",
    ]
    rows = experiments.recommend(metrics, ["run_id"], unmeasured=unmeasured)
    return rows.withColumn("ord", F.col("ord").cast("long"))


#: Metrics of the style extracted from images, which no given table has.
FROM_IMAGES = ("subtitle_style_extraction_score", "vertical_overlay_aspect_compliant", "vertical_style_completeness")

# The rules written out, so that a wrong constant of the library shows.
_RULES = """values
  ('audio_abrupt_start_count > 0 or audio_abrupt_end_count > 0', 'improve_cut_points'),
  ('audio_abrupt_start_count > 0 or audio_abrupt_end_count > 0', 'improve_crossfade'),
  ('audio_tp_violations > 0', 'improve_loudness_target'),
  ('subtitle_timing_violations > 0', 'improve_subtitle_timing'),
  ('subtitle_reading_speed_violations > 0', 'improve_subtitle_readability'),
  ('critical_issue_count > 3', 'improve_topic_segmentation'),
  ('subtitle_errata_violations > 0', 'improve_subtitle_errata'),
  ('subtitle_errata_violations > 0', 'improve_asr_phonetic_correction'),
  ('subtitle_errata_violations > 0', 'improve_sentence_by_sentence_audit'),
  ('subtitle_errata_violations > 0', 'word_level_verification'),
  ('subtitle_overlap_count > 0', 'zero_tolerance_subtitle_overlap'),
  ('word_level_error_count > 0', 'word_level_verification'),
  ('generation_efficiency_score < 90', 'improve_generation_efficiency'),
  ('subtitle_style_score < 90', 'improve_subtitle_frosted_glass'),
  ('alignment_score < 85', 'improve_alignment_quality'),
  ('not loudness_normalization_pass or loudness_lufs_deviation > 1.0', 'improve_loudness_two_pass'),
  ('subtitle_semantic_completeness < 80', 'improve_subtitle_semantic_segmentation'),
  ('subtitle_semantic_completeness < 80', 'improve_subtitle_multiline'),
  ('subtitle_visual_bounds_score < 90', 'improve_subtitle_background_fit'),
  ('subtitle_font_size_score < 80', 'improve_subtitle_font_size'),
  ('subtitle_filler_cleanup_score < 85', 'improve_subtitle_semantic_segmentation'),
  ('subtitle_fragment_count > 0', 'improve_subtitle_fragment_merging')"""


def _rule_rows() -> str:
    """The threshold rules on metrics of the report as rows of (place, strategy)."""
    rules = re.findall(r"\('(.+)', '(\w+)'\)", _RULES)
    return " union all ".join(f"select version_key, {k} as k, '{name}' as strategy from metrics where {test}" for k, (test, name) in enumerate(rules))


@query("report_strategies", O.with_(*S.REPORT_BASE, S._REPORT_ISSUES, S.METRICS) + f""", hits as ({_rule_rows()})
select version_key, row_number() over (partition by version_key order by k) - 1 as ord, strategy from hits""")
def report_strategies(spark, sf):
    """Strategies for the metrics of every version's report."""
    rows = experiments.recommend(S.metrics_of(spark, sf), ["version_key"], unmeasured=FROM_IMAGES)
    return rows.withColumn("ord", F.col("ord").cast("long"))


@query("modification_recommendations", O.with_(S._SCENARIOS) + """,
m as (select run_id, count(*) filter (workflow_selection_correct) / count(*) * 100 as w, avg(parameter_compliance) as p,
  avg(output_completeness) as o, avg(quality_compliance) as q from delivered group by 1),
hits as (
  select run_id, 1 as k, 'add_decision_tree' as strategy from m where w < 80
  union all select run_id, 1 + k, s from m, (values (1, 'add_output_spec_per_workflow'), (2, 'add_delivery_template'), (3, 'add_packaging_output_spec'),
    (4, 'add_platform_output_spec'), (5, 'add_multi_workflow_spec')) v(k, s) where o < 80
  union all select run_id, 6 + k, s from m, (values (1, 'add_parameter_tables'), (2, 'add_examples')) v(k, s) where p < 80
  union all select run_id, 9, 'add_error_recovery' from m where q < 80
  union all select run_id, 10, 'review' from m where w >= 80 and o >= 80 and p >= 80 and q >= 80)
select run_id, row_number() over (partition by run_id order by k) - 1 as ord, strategy from hits""")
def modification_recommendations(spark, sf):
    from cueline.operators.scoring import scenario_rollup

    rows = scenario_rollup(S.scenarios(spark, sf), ["run_id"])
    found = experiments.recommend(rows, ["run_id"], experiments.MODIFICATION_RULES, fallback=["review"])
    return found.withColumn("ord", F.col("ord").cast("long"))


_LOG = "select ts as timestamp, case event_type when 'error' then 'ERROR' when 'click' then 'WARNING' else 'INFO' end as level, event_type as component from events"


@query("log_levels", f"with log as ({_LOG}) select level, count(*) as n from log group by rollup(level)")
def log_levels(spark, sf):
    return experiments.log_levels(log_rows(spark, sf))


def log_rows(spark, sf):
    kind = F.col("event_type")
    return X.table(spark, sf, "events").select(
        F.col("ts").cast("string").alias("timestamp"),
        F.when(kind == "error", "ERROR").when(kind == "click", "WARNING").otherwise("INFO").alias("level"),
        kind.alias("component"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), F.col("props").alias("data"),
    )


@query("latest_log", "select event_id from events order by ts desc, event_id desc limit 20")
def latest_log(spark, sf):
    log = log_rows(spark, sf).withColumn("event_id", F.regexp_extract("message", r"(\d+)", 1).cast("long"))
    return experiments.latest_log(log, 20, tie=["event_id"]).select("event_id")


@query("parameter_sets", """
with named as (
  select o_custkey as set_id, ['reading_speed', 'max_chars', 'min_gap_s', 'crossfade_ms', 'max_display_s', 'breath_mode', 'min_display_s'][o_orderkey % 7 + 1] as name,
    o_orderkey as value_order, o_orderkey % 50 + 0.5 as value from orders),
latest as (select set_id, name, arg_max(value, value_order) as value from named group by all)
select set_id, coalesce(string_agg(name || '=' || cast(value as double), ',' order by name) filter (name not in ('crossfade_ms', 'breath_mode')), '') as changes,
  coalesce(string_agg(name, ',' order by name) filter (name in ('crossfade_ms', 'breath_mode')), '') as rejected,
  count(*) filter (name in ('crossfade_ms', 'breath_mode')) = 0 as usable
from latest group by set_id""")
def parameter_sets(spark, sf):
    """Named parameter sets, and the names in them that no parameter has."""
    names = F.array(*map(F.lit, ("reading_speed", "max_chars", "min_gap_s", "crossfade_ms", "max_display_s", "breath_mode", "min_display_s")))
    o = F.col("o_orderkey")
    rows = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("set_id"), F.get(names, (o % 7).cast("int")).alias("name"), o.alias("value_order"), (o % 50 + 0.5).cast("double").alias("value"))
    found = experiments.checked_settings(rows, ["set_id"])
    shown = F.transform(F.map_entries("changes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("set_id", F.array_join(F.sort_array(shown), ",").alias("changes"), F.array_join("rejected", ",").alias("rejected"), "usable")


@query("keep_or_discard")
def keep_or_discard(spark, sf):
    """Three trials over the whole corpus; each measures a full merge and audit."""
    trial = experiments.Experiment(LATIN, jobs.measure_corpus(X.segments(spark, sf), ["transcript_id"]))
    trial.set_baseline()
    trial.run({"max_display_s": 10.0}, "longer display")
    trial.run({"no_such_limit": 1.0}, "unknown parameter")
    trial.run({"reading_speed": 20.0}, "faster reading")
    log = trial.log(spark)
    return log.select("experiment_id", "notes", "improved", "kept", F.element_at("metrics_after", "overall_score").alias("overall_score"))


_LOOSENED = f"""
present as (select count(*) filter (issue_type = 'reading_speed_too_fast') > 0 as fast, count(*) filter (issue_type = 'gap_too_short') > 0 as close,
  count(*) filter (issue_type = 'duration_too_short') > 0 as brief, count(*) filter (issue_type = 'line_too_long') > 0 as wide from timing_issues),
limits as (select case when fast then 18.5::double else 18.0::double end as standard,
  case when close then greatest(0.033::double, 0.067::double - 0.02::double) else 0.067::double end as gap,
  case when brief then greatest(0.8::double, 1.0::double - 0.1::double) else 1.0::double end as shortest, case when wide then 41 else 42 end as chars,
  concat_ws(',', case when wide then 'max_chars' end, case when brief then 'min_display_s' end, case when close then 'min_gap_s' end,
    case when fast then 'reading_speed' end) as changed from present),
again as (
  select issue_type from timing_issues
  where issue_type not in ('duration_too_short', 'reading_speed_too_fast', 'reading_speed_fast', 'gap_too_short', 'line_too_long')
  union all select 'duration_too_short' from entries, limits where dur < shortest
  union all select case when {C.RATE} > standard * 2 then 'reading_speed_too_fast' else 'reading_speed_fast' end from entries, limits
    where {C.N} > 0 and {C.RATE} > standard * 1.5
  union all select 'gap_too_short' from entries, limits where start_ms >= before_ms and (start_ms - before_ms) / 1000 < gap
  union all select 'line_too_long' from (select {O.letters('line')} as n from (select unnest(string_split(text, chr(10))) as line from entries)), limits where n > chars)"""


@query("adaptive_parameters", O.with_(*S.BASE, S.TIMING_ISSUES, _LOOSENED) + " select issue_type, count(*) as n, changed from again, limits group by all")
def adaptive_parameters(spark, sf):
    """Parameters after loosening what the issues of the corpus point at."""
    from cueline.operators import checks

    present = experiments.issue_types_present(C.found(spark, sf, C.timing(spark)))
    params, changed = experiments.adapt_params(present, LATIN)
    found = checks.issues(C.entries(spark, sf), C.KEY, F.col("seg_idx"), checks.timing_family(params, C.latin_rules(spark)))
    return found.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n")).withColumn("changed", F.lit(",".join(changed)))
