"""Whole jobs: transcripts to subtitles, clips to files, parameter sweeps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import text as txt
from cueline.operators import checks, merging, scoring, timeline
from cueline.operators.experiments import SWEEP_SETTINGS, adapt_params, issue_types_present, resolve_settings
from cueline.operators.ordered import dense_position
from cueline.operators.rules import Rules, apply_literal, flatten_rules, inline_rules, normalise
from cueline.params import PUBLISHING, SubtitleParams
from cueline.plans import audit
from cueline.session import materialise
from cueline.sources import readers

LATIN_SETTINGS = tuple(
    (name, {k: v * 42 // 18 if k == "max_chars" else v * 4.5 if k == "reading_speed" else v for k, v in changes.items()})
    for name, changes in SWEEP_SETTINGS
)
"""The sweep settings scaled to the Latin profile."""


def simple_subtitles(
    segments: DataFrame,
    keys: Sequence[str],
    params: SubtitleParams = PUBLISHING,
    corrections: Sequence[tuple[str, str]] = (),
    strip_period: bool = True,
    block_rows: int = 50_000,
) -> DataFrame:
    """One subtitle per non-blank segment: corrected, without final full stop,
    laid out on lines, numbered and retimed."""
    rows = segments.withColumn("text", txt.strip(F.col("text"))).where("text <> ''")
    text = apply_literal(F.col("text"), corrections)
    if strip_period:
        text = txt.strip_full_stop(text)
    rows = rows.drop("pos", "n_rows").withColumns(
        {"text": F.array_join(txt.two_lines(text, params.max_chars, max(2, params.max_lines)), "\n"), "_range": F.floor(F.col("seg_idx") / block_rows)}
    )
    numbered = dense_position(rows, keys, ["_range"], ["seg_idx"], "_pos").drop("_range")
    return timeline.adjust_timing(numbered, keys, "_pos", params).withColumn("index", F.col("_pos") + 1).drop("_pos")


def process_entries(
    rows: DataFrame,
    keys: Sequence[str],
    pos: str,
    params: SubtitleParams = SubtitleParams(),
    rules: Rules = Rules(),
    custom: Sequence[tuple[str, str]] = (),
    strip_punctuation: bool = True,
) -> DataFrame:
    """Entries with their text normalised, corrected, punctuated and fitted to a line."""
    ahead = timeline.with_next(rows, keys, pos)
    body = apply_literal(normalise(F.col("text"), rules), custom)
    shown = txt.display_text(
        body, F.col("next_text"), (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("next_gap_ms") / 1000, F.col("is_last"),
        params, strip_punctuation,
    )
    return ahead.withColumn("text", shown).drop("next_text", "next_gap_ms", "is_last", "next_start_ms")


def clip_job(
    entries: DataFrame,
    clips: DataFrame,
    params: SubtitleParams = SubtitleParams(),
    rules: Rules = Rules(),
    custom: Sequence[tuple[str, str]] = (),
    key: str = "transcript_id",
) -> DataFrame:
    """Subtitles of every clip of every transcript in one job: extract, process
    the text, merge short entries, remove overlaps."""
    keys = [key, "clip_id"]
    cut = timeline.number_in_clip(timeline.extract_clip_entries(entries, clips, key), keys)
    shown = process_entries(cut, keys, "clip_pos", params, rules, custom)
    seconds = shown.withColumns({"start_s": F.col("start_ms") / 1000, "end_s": F.col("end_ms") / 1000})
    return merging.merge_clip_entries(seconds, keys, params.max_chars, params.min_display_s)


def clip_results(clips: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per clip with its number of subtitles and its errors; a clip that
    yields nothing or is ill-defined gets an error, the others are unaffected."""
    keys = list(keys)
    counts = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = clips.join(counts, keys, "left")
    errors = F.array_compact(
        F.array(
            F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "missing time"),
            F.when(F.col("end_ms") <= F.col("start_ms"), "end before start"),
            F.when(F.coalesce("_n", F.lit(0)) == 0, "no subtitles"),
        )
    )
    return rows.withColumns({"subtitle_count": F.coalesce("_n", F.lit(0)), "errors": errors}).drop("_n")


def sweep(
    segments: DataFrame,
    keys: Sequence[str],
    base: SubtitleParams,
    settings: Sequence[tuple[str, dict]] = SWEEP_SETTINGS,
    standard: SubtitleParams = PUBLISHING,
) -> DataFrame:
    """Every parameter setting over the whole corpus in one job.

    All settings run side by side over one pass of the rows, which leaves each entry with
    its neighbours beside it: timing, checks and counts need no further order. The setting is
    part of the key of the report. Gives one row per setting with mean scores and summed issues.
    """
    chosen = resolve_settings(base, settings)
    merged = merging.run_settings_beside(segments, keys, merging.FULL_CHAIN, chosen)
    entries = timeline.finish_beside(merged.withColumn("param_id", F.element_at("param_ids", 1)), chosen)
    ready = entries.withColumn("body", F.when(F.col("gap_ms") < 0, txt.strip(F.col("text"))))
    counts = scoring.alignment_counts(ready, ["param_ids", *keys], checks.alignment_checks(base, standard), base)
    each = counts.withColumn("param_id", F.explode("param_ids")).drop("param_ids")
    report = scoring.alignment_scores(each, ["param_id", *keys])
    return report.groupBy("param_id").agg(
        F.avg("alignment_score").alias("alignment_score"),
        F.sum("critical_count").alias("critical_count"),
        F.sum("warning_count").alias("warning_count"),
        F.sum("total_segments").alias("merged_count"),
        F.count_if("publishing_ready").alias("n_publishing_ready"),
    )


def load_project(
    spark: SparkSession, transcripts: str, rules: str, params: SubtitleParams = SubtitleParams()
) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """Segments in time order, their merged entries and the flattened literal rules
    of a folder of transcripts."""
    keys = ["transcript_id"]
    segments = timeline.with_time_order(materialise(readers.read_transcripts(spark, transcripts), "project"), keys)
    entries = merging.transcript_to_entries(segments, keys, params)
    return segments, entries, inline_rules(flatten_rules(readers.read_rules(spark, rules)))


@dataclass
class Iteration:
    number: int
    params: SubtitleParams
    total_score: float
    critical_issues: int
    warnings: int
    all_passed: bool
    changed: list[str]


def research(
    segments: DataFrame,
    keys: Sequence[str],
    params: SubtitleParams,
    rules: Rules = Rules(),
    standard: SubtitleParams = PUBLISHING,
    max_iterations: int = 3,
) -> list[Iteration]:
    """Merge, audit and loosen the limits the issues point at, until all pass.

    Each iteration is a few Spark jobs over the whole corpus; only one row of
    totals and the set of issue types come to the driver.
    """
    history: list[Iteration] = []
    for number in range(1, max_iterations + 1):
        entries = materialise(merging.transcript_to_entries(segments, keys, params), "entries")
        shown = process_entries(entries, keys, "pos", params, rules)
        context = checks.with_entry_context(shown, keys, "pos", params=params)
        aligned = checks.with_segment_context(segments, keys, "pos", params)
        scores = audit.single_iteration(context, aligned, keys, params, standard, rules)
        row = scores.agg(
            F.avg("total_score").alias("score"), F.sum("critical_issues").alias("c"), F.sum("warnings").alias("w"),
            F.bool_and("all_passed").alias("ok"),
        ).first()
        families = (checks.timing_family(params, rules), checks.content_family(params, rules))
        present = issue_types_present(checks.issues(context, keys, F.col("pos"), *families))
        used, (params, changed) = params, adapt_params(present, params)
        history.append(Iteration(number, used, row.score, row.c, row.w, row.ok, changed))
        if row.ok or not changed:
            break
    return history


def measure_corpus(segments: DataFrame, keys: Sequence[str], rules: Rules = Rules()) -> Callable[[SubtitleParams], DataFrame]:
    """A measuring function for experiments: merge the corpus, score it, give one row."""

    def measure(params: SubtitleParams) -> DataFrame:
        entries = merging.transcript_to_entries(segments, keys, params)
        context = checks.with_entry_context(entries, keys, "pos", params=params)
        scores = scoring.timing_score(context, keys, checks.timing_family(params, rules, places=False))
        return scores.agg(
            F.avg("score").alias("overall_score"), F.sum("critical_count").alias("critical_issue_count"),
            F.sum("warning_count").alias("warning_count"), F.lit(0).alias("subtitle_fragment_count"),
            F.bool_and("passed").alias("passed"),
        )

    return measure
