"""Experiment analytics: comparisons, logs, sweeps and the keep-or-discard loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.operators.ordered import over_neighbours, running_max, running_total
from cueline.params import SubtitleParams

IMPROVEMENT = 0.5

# -- Fixed values: thresholds that recommend a strategy, in order ----------------------

STRATEGY_RULES = (
    (("audio_abrupt_start_count", ">", 0, "audio_abrupt_end_count", ">", 0), ("improve_cut_points", "improve_crossfade")),
    (("audio_tp_violations", ">", 0), ("improve_loudness_target",)),
    (("subtitle_timing_violations", ">", 0), ("improve_subtitle_timing",)),
    (("subtitle_reading_speed_violations", ">", 0), ("improve_subtitle_readability",)),
    (("critical_issue_count", ">", 3), ("improve_topic_segmentation",)),
    (
        ("subtitle_errata_violations", ">", 0),
        ("improve_subtitle_errata", "improve_asr_phonetic_correction", "improve_sentence_by_sentence_audit", "word_level_verification"),
    ),
    (("subtitle_overlap_count", ">", 0), ("zero_tolerance_subtitle_overlap",)),
    (("word_level_error_count", ">", 0), ("word_level_verification",)),
    (("generation_efficiency_score", "<", 90), ("improve_generation_efficiency",)),
    (("subtitle_style_score", "<", 90), ("improve_subtitle_frosted_glass",)),
    (("subtitle_style_extraction_score", "<", 80), ("improve_style_extraction",)),
    (("vertical_overlay_aspect_compliant", "<", 1), ("improve_vertical_style_completeness",)),
    (("vertical_style_completeness", "<", 90), ("improve_vertical_style_completeness",)),
    (("alignment_score", "<", 85), ("improve_alignment_quality",)),
    (("loudness_normalization_pass", "<", 1, "loudness_lufs_deviation", ">", 1.0), ("improve_loudness_two_pass",)),
    (("subtitle_semantic_completeness", "<", 80), ("improve_subtitle_semantic_segmentation", "improve_subtitle_multiline")),
    (("subtitle_visual_bounds_score", "<", 90), ("improve_subtitle_background_fit",)),
    (("subtitle_font_size_score", "<", 80), ("improve_subtitle_font_size",)),
    (("subtitle_filler_cleanup_score", "<", 85), ("improve_subtitle_semantic_segmentation",)),
    (("subtitle_fragment_count", ">", 0), ("improve_subtitle_fragment_merging",)),
)
MODIFICATION_RULES = (
    (("workflow_selection_accuracy", "<", 80), ("add_decision_tree",)),
    (
        ("output_completeness", "<", 80),
        ("add_output_spec_per_workflow", "add_delivery_template", "add_packaging_output_spec", "add_platform_output_spec", "add_multi_workflow_spec"),
    ),
    (("parameter_compliance", "<", 80), ("add_parameter_tables", "add_examples")),
    (("quality_compliance", "<", 80), ("add_error_recovery",)),
)
SWEEP_SETTINGS = (
    ("baseline", {}),
    ("wider_max_display_10s", {"max_display_s": 10.0}),
    ("wider_max_display_12s", {"max_display_s": 12.0}),
    ("increase_max_chars_18", {"max_chars": 18}),
    ("increase_max_chars_20", {"max_chars": 20}),
    ("increase_max_chars_22", {"max_chars": 22}),
    ("combo_max10_chars18", {"max_display_s": 10.0, "max_chars": 18}),
    ("combo_max10_chars20", {"max_display_s": 10.0, "max_chars": 20}),
    ("combo_max12_chars20", {"max_display_s": 12.0, "max_chars": 20}),
    ("combo_max12_chars22", {"max_display_s": 12.0, "max_chars": 22}),
    ("combo_max15_chars22", {"max_display_s": 15.0, "max_chars": 22}),
    ("combo_max10_chars18_speed3.5", {"max_display_s": 10.0, "max_chars": 18, "reading_speed": 3.5}),
    ("combo_max12_chars20_speed3.5", {"max_display_s": 12.0, "max_chars": 20, "reading_speed": 3.5}),
    ("combo_max15_chars25_speed3", {"max_display_s": 15.0, "max_chars": 25, "reading_speed": 3.0}),
)


def _holds(rule: tuple) -> Column:
    """Any of the (metric, operator, threshold) triples of a rule."""
    hit = F.lit(False)
    for i in range(0, len(rule), 3):
        metric = F.col(rule[i]).cast("double")
        test = metric > rule[i + 2] if rule[i + 1] == ">" else metric < rule[i + 2]
        hit = hit | F.coalesce(test, F.lit(False))
    return hit


def recommend(
    metrics: DataFrame, keys: Sequence[str], rules=STRATEGY_RULES, fallback: Sequence[str] = (), unmeasured: Sequence[str] = ()
) -> DataFrame:
    """Strategies whose thresholds the metrics cross, in rule order, repeats kept.

    A rule on a metric that the table lacks is an error, unless the metric is
    named in ``unmeasured``: then the rule can't fire. The rule list is a
    literal, so this is one projection. ``fallback`` is used where nothing applies.
    """
    needed = {r[i] for r, _ in rules for i in range(0, len(r), 3)}
    if missing := sorted(needed - set(metrics.columns) - set(unmeasured)):
        raise ValueError(f"metrics without a column: {', '.join(missing)}")
    metrics = metrics.withColumns({name: F.lit(None).cast("double") for name in unmeasured if name not in metrics.columns})
    usable = list(rules)
    none = F.array().cast("array<string>")
    parts = [F.when(_holds(r), F.array(*map(F.lit, names))).otherwise(none) for r, names in usable]
    found = F.concat(*parts) if parts else none
    if fallback:
        found = F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, fallback)))
    return metrics.select(*keys, F.posexplode(found).alias("ord", "strategy"))


# -- comparisons ----------------------------------------------------------------------


def _flags(score, critical, fragments, passed, prefix: str = "_before_") -> dict[str, Column]:
    before = lambda c: F.col(prefix + c)
    delta = F.col(score) - before(score)
    newly = F.col(passed) & ~before(passed)
    fewer = F.col(critical) < before(critical)
    return {
        "improved": newly | (delta >= IMPROVEMENT) | ((F.abs(delta) < IMPROVEMENT) & fewer)
        | ((F.col(fragments) < before(fragments)) & (F.col(score) >= before(score) - 0.1)),
        "regressed": (before(passed) & ~F.col(passed)) | (delta < 0),
    }


def compare_with_previous(
    trials: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    metrics: Sequence[str] = ("overall_score", "critical_count", "fragment_count"),
    score: str = "overall_score",
    critical: str = "critical_count",
    fragments: str = "fragment_count",
    passed: str = "passed",
    **options,
) -> DataFrame:
    """Each trial against the one before it: deltas, improved, regressed.

    Both flags may hold. The first trial has NULLs."""
    wanted = list(dict.fromkeys([*metrics, score, critical, fragments, passed]))
    rows = over_neighbours(
        trials, keys, pos, {f"_before_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in wanted}, before=1, **options
    )
    flags = _flags(score, critical, fragments, passed)
    return rows.withColumns(
        {**{f"{m}_delta": F.col(m) - F.col(f"_before_{m}") for m in metrics}, **flags, "passed_before": F.col(f"_before_{passed}")}
    ).drop(*[f"_before_{c}" for c in wanted])


def compare_metrics(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str], **names) -> DataFrame:
    """Two metric tables joined on the keys; deltas are rounded to 2 digits."""
    keys = list(keys)
    cols = {"score": "overall_score", "critical": "critical_issue_count", "fragments": "subtitle_fragment_count", "passed": "passed"} | names
    wanted = list(dict.fromkeys([*metrics, *cols.values()]))
    left = before.select(*keys, *[F.col(c).alias(f"_before_{c}") for c in wanted])
    flags = _flags(cols["score"], cols["critical"], cols["fragments"], cols["passed"])
    return after.join(left, keys).select(
        *keys,
        *[F.bround((F.col(m) - F.col(f"_before_{m}")).cast("double"), 2).alias(f"{m}_delta") for m in metrics],
        *[c.alias(n) for n, c in flags.items()],
        F.col(f"_before_{cols['passed']}").alias("passed_before"),
        F.col(cols["passed"]).alias("passed_after"),
    )


def experiment_summary(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of a log with ``improved``, ``kept`` and ``compared`` (has a comparison)."""
    n, better = F.count(F.lit(1)), F.count_if(F.coalesce("improved", F.lit(False)))
    kept = F.count_if(F.coalesce("kept", F.lit(False)))
    return records.groupBy(*keys).agg(
        n.alias("total_experiments"), better.alias("improvements"),
        F.count_if(~F.coalesce("improved", F.lit(False)) & F.col("compared")).alias("regressions"),
        kept.alias("kept_changes"), (n - kept).alias("discarded_changes"),
        (better / F.greatest(F.lit(1), n) * 100).alias("improvement_rate"),
    )


def latest_record(records: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    by = F.struct(*order)
    return records.groupBy(*keys).agg(*[F.max_by(c, by).alias(c) for c in columns])


def best_so_far(
    trials: DataFrame, keys: Sequence[str], pos: str = "pos", score: str = "overall_score", patience: int = 5, **options
) -> DataFrame:
    """Running best before each trial, whether it improved on it, and stagnation.

    ``stagnation`` counts trials since the last improvement; it starts anew
    after reaching ``patience``, when ``escalate`` is set.
    """
    rows = running_max(trials, keys, pos, {"best_before": score}, inclusive=False, **options)
    floor = F.coalesce("best_before", F.lit(0.0))
    rows = rows.withColumns({"improved": F.col(score) > floor})
    rows = rows.withColumn("_at", F.when(F.col("improved"), F.col(pos)))
    rows = running_max(rows, keys, pos, {"_last": "_at"}, **options)
    idle = F.when(F.col("_last").isNull(), F.col(pos) + 1).otherwise(F.col(pos) - F.col("_last"))
    cycle = F.when(idle > 0, (idle - 1) % patience + 1).otherwise(F.lit(0))
    return rows.withColumns({"stagnation": cycle, "escalate": cycle == patience}).drop("_at", "_last")


def log_levels(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lines per level with the total as the row of NULL level."""
    return log.select(*keys, "level").rollup(*keys, "level").agg(F.count(F.lit(1)).alias("n"))


def latest_log(log: DataFrame, n: int = 20, tie: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` lines by time, then by the ``tie`` columns, then by all others, latest first."""
    rest = [c for c in log.columns if c != "timestamp" and c not in tie]
    return log.orderBy(*[F.desc_nulls_last(c) for c in ("timestamp", *tie, *rest)]).limit(n)


# -- sweeps and loops -----------------------------------------------------------------


def resolve_settings(base: SubtitleParams, settings: Sequence[tuple[str, dict]]) -> dict[str, SubtitleParams]:
    return {name: base.with_values(**changes) for name, changes in settings}


def checked_settings(settings: DataFrame, keys: Sequence[str], known: Sequence[str] | None = None) -> DataFrame:
    """Named parameter sets (one row per ``name, value`` of a set) as one row per set.

    ``changes`` maps the known names to their values (the last ``value_order`` wins), ``rejected``
    lists the unknown ones in order, and ``usable`` tells sets without any.
    """
    known = [f.name for f in fields(SubtitleParams)] if known is None else list(known)
    rows = settings.groupBy(*keys, "name").agg(F.max_by("value", "value_order").alias("value"))
    entry = F.struct("name", "value")
    sets = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("name").isin(known), entry))).alias("_changes"),
        F.sort_array(F.collect_list(F.when(~F.col("name").isin(known), F.col("name")))).alias("rejected"),
    )
    return sets.select(*keys, F.map_from_entries("_changes").alias("changes"), "rejected", (F.size("rejected") == 0).alias("usable"))


def best_setting(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The setting with the highest score, then fewest criticals, then warnings."""
    order = F.struct(F.col("alignment_score"), -F.col("critical_count"), -F.col("warning_count"))
    return results.groupBy(*keys).agg(
        F.max_by("param_id", order).alias("best_param_id"), F.max("alignment_score").alias("best_score")
    )


def adapt_params(issue_types: set[str], params: SubtitleParams) -> tuple[SubtitleParams, list[str]]:
    """Loosen the limits that the issue types point at."""
    changes: dict = {}
    if "reading_speed_too_fast" in issue_types:
        changes["reading_speed"] = params.reading_speed + 0.5
    if "gap_too_short" in issue_types and params.min_gap_s > 0.03:
        changes["min_gap_s"] = max(0.033, params.min_gap_s - 0.02)
    if "duration_too_short" in issue_types:
        changes["min_display_s"] = max(0.8, params.min_display_s - 0.1)
    if "line_too_long" in issue_types:
        changes["max_chars"] = max(14, params.max_chars - 1)
    return params.with_values(**changes), sorted(changes)


def issue_types_present(issues: DataFrame) -> set[str]:
    """Distinct issue types: a handful of fixed names, safe to bring to the driver."""
    return {r.issue_type for r in issues.select("issue_type").distinct().collect()}


RECORD_SCHEMA = (
    "experiment_id string, timestamp string, direction string, changes map<string,string>, "
    "metrics_before map<string,double>, metrics_after map<string,double>, "
    "compared boolean, improved boolean, kept boolean, notes string"
)


@dataclass
class Experiment:
    """Try parameter changes, keep those that improve the measured metrics.

    ``measure`` runs one Spark job: it takes parameters and returns a one-row
    DataFrame of metrics (``overall_score``, ``critical_issue_count``,
    ``subtitle_fragment_count``, ``passed``, …). A change of an unknown
    parameter is recorded and not run; a failing job is recorded and undone.
    """

    params: SubtitleParams
    measure: Callable[[SubtitleParams], DataFrame]
    direction: str = "general_quality"
    current: dict | None = None
    baseline: dict | None = None
    records: list[tuple] = field(default_factory=list)

    def _metrics(self, params: SubtitleParams) -> dict:
        return self.measure(params).first().asDict()

    def set_baseline(self) -> None:
        self.baseline = self.current = self._metrics(self.params)

    def run(self, changes: dict, notes: str = "") -> dict:
        number = len(self.records) + 1
        before, after, compared, better = self.current, None, False, False
        try:
            candidate = self.params.with_values(**changes)
        except KeyError as error:
            return self._record(number, changes, before, None, False, False, f"VALIDATION FAILED: {error.args[0]}")
        try:
            after = self._metrics(candidate)
        except Exception as error:  # a failed trial must not end the loop
            return self._record(number, changes, before, None, False, False, f"EXPERIMENT FAILED: {error}")
        if before is not None:
            compared, better = True, improves(before, after)
        if better:
            self.params, self.current = candidate, after
        return self._record(number, changes, before, after, compared, better, notes)

    def _record(self, number, changes, before, after, compared, better, notes):
        numeric = lambda m: None if m is None else {k: float(v) for k, v in m.items() if isinstance(v, (int, float))}
        row = (
            f"exp_{number:04d}", datetime.now(timezone.utc).isoformat(), self.direction,
            {k: str(v) for k, v in changes.items()}, numeric(before), numeric(after), compared, better, better, notes,
        )
        self.records.append(row)
        return {"improved": better, "kept": better, "metrics_before": before, "metrics_after": after, "notes": notes}

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, RECORD_SCHEMA)

    def status(self) -> dict:
        score = lambda m: None if m is None else m["overall_score"]
        return {
            "direction": self.direction, "experiment_count": len(self.records),
            "baseline_score": score(self.baseline), "current_score": score(self.current),
        }


def improves(before: dict, after: dict) -> bool:
    """Newly passed, or clearly better, or equal with fewer criticals or fragments."""
    delta = after["overall_score"] - before["overall_score"]
    fewer = lambda name: after[name] < before[name]
    return bool(
        (after["passed"] and not before["passed"])
        or delta >= IMPROVEMENT
        or (abs(delta) < IMPROVEMENT and fewer("critical_issue_count"))
        or (after["overall_score"] >= before["overall_score"] - 0.1 and fewer("subtitle_fragment_count"))
    )
