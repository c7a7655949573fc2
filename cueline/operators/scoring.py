"""Scores, reports and recommendations from issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.operators.checks import Check, how_many, is_interruption, severity_count, type_count
from cueline.params import PUBLISHING, SubtitleParams

# -- Fixed values: issue types and weights of the scores ------------------------------

CONTENT_ERROR_TYPES = (
    "errata_violation", "traditional_chinese", "wrong_name", "wrong_work",
    "asr_phonetic_error", "semantic_anomaly", "contextual_errata",
    "contextual_idiom_errata", "contextual_work_errata",
    "word_level_error", "subtitle_overlap",
)
TIMING_ERROR_TYPES = ("timestamp_overlap", "zero_or_negative_duration", "subtitle_overlap")
ISSUE_BUCKETS = (
    ("subtitle_timing_violations", ("duration_too_short", "duration_too_long")),
    ("subtitle_reading_speed_violations", ("reading_speed_too_fast", "reading_speed_fast")),
    ("subtitle_line_length_violations", ("line_too_long",)),
    ("subtitle_overlap_count", ("overlap", "subtitle_overlap")),
)
ERRATA_TYPES = (
    "errata_violation", "traditional_chinese", "wrong_name", "wrong_work", "asr_phonetic_error", "semantic_anomaly",
)
TRUNCATION_TYPES = ("line_start_forbidden", "line_end_forbidden", "suspected_fragment")
MULTILINE_TYPES = ("multi_line_subtitle", "too_many_lines", "line_too_long")
FILLER_TYPES = ("meaningless_filler", "word_level_filler_sound")
FRAGMENT_TYPES = ("suspected_fragment", "truncated_subtitle")
RECOMMENDATIONS = (
    ("loudness", "执行两遍响度标准化（loudnorm），确保符合平台目标LUFS"),
    ("abrupt", "调整切点至自然停顿处，增加淡入/淡出时间"),
    ("timing", "修正字幕时间轴：调整过短字幕、消除重叠、控制阅读速度"),
    ("breath", "优化呼吸声处理：降低音量至-18~-24dB而非完全删除"),
    ("clear", "所有检查通过，质量达标，可进入发布流程"),
    ("errata", "字幕勘误存在违规：检查人名/作品/成语/常识等错误"),
    ("style", "字幕样式不达标：确保BorderStyle=3、Noto Sans SC字体、ScaledBorderAndShadow"),
    ("efficiency", "生成效率不达标：启用skip_existing避免重复处理"),
)
FULL_VALIDATION_TEXTS = (
    ("traditional_chinese_detected", "【紧急】字幕中仍存在繁体字，需加强繁简转换"),
    ("errata_violation", "【紧急】字幕中存在勘误词，需添加纠错规则"),
    ("multi_line_subtitle", "【紧急】字幕存在多行，需强制单行处理"),
    ("timing", "字幕时序验证未通过，需调整显示时长或阅读速度参数"),
    ("alignment", "字幕对齐未达发布标准，需优化时间戳精度"),
    ("clear", "所有验证通过，音视频制成品达标，可进入发布流程"),
)


def severity_rollup(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    return issues.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count_if(F.col("severity") == "info").alias("info_count"),
    )


def issue_histogram(issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return issues.groupBy(*keys, "severity", "issue_type").agg(F.count(F.lit(1)).alias("n"))


def previews(issues: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` issues of each key in the given order."""
    from pyspark.sql import Window

    ranked = issues.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def _floor0(score: Column) -> Column:
    return F.greatest(F.lit(0.0), score)


def _counts(found: Column) -> dict[str, Column]:
    return {"_c": severity_count(found, "critical"), "_w": severity_count(found, "warning")}


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_entries"), F.sum("_c").alias("critical_count"), F.sum("_w").alias("warning_count"),
    ]


def _timing_result(c: Column, w: Column) -> tuple[Column, Column]:
    return _floor0((100 - 15 * c - 2 * w).cast("double")), c == 0


def _content_result(c: Column, w: Column, e: Column, n: Column) -> tuple[Column, Column, Column]:
    accuracy = F.when(n > 0, (n - e) / n * 100).otherwise(F.lit(100.0))
    score = _floor0(100 - c * 15 - F.least(w * F.lit(0.1), F.lit(15.0)))
    return score, accuracy, (c == 0) & ~((accuracy < 99.9) & (e > 0))


def _critical_errors(found: Column, error_types: Sequence[str]) -> Column:
    return F.size(F.filter(found, lambda i: (i["severity"] == "critical") & i["issue_type"].isin(*error_types)))


def timing_score(df: DataFrame, keys: Sequence[str], found: Column) -> DataFrame:
    """max(0, 100 − 15 criticals − 2 warnings) per key; passed without criticals."""
    score, passed = _timing_result(F.col("critical_count"), F.col("warning_count"))
    return (
        df.withColumn("_found", found)
        .select(*keys, *[v.alias(k) for k, v in _counts(F.col("_found")).items()])
        .groupBy(*keys)
        .agg(*_sums())
        .withColumns({"score": score, "passed": passed})
    )


def content_score(
    df: DataFrame, keys: Sequence[str], found: Column, error_types: Sequence[str] = CONTENT_ERROR_TYPES
) -> DataFrame:
    """Score, accuracy and pass of the content checks.

    100 − 15 criticals − at most 15 for warnings at 0.1 each. Accuracy counts
    critical issues of ``error_types`` against the number of entries; below
    99.9 % with any such error fails.
    """
    c, w, n, e = (F.col(x) for x in ("critical_count", "warning_count", "total_entries", "errata_error_count"))
    score, accuracy, passed = _content_result(c, w, e, n)
    return (
        df.withColumn("_found", found)
        .select(*keys, *[v.alias(k) for k, v in _counts(F.col("_found")).items()], _critical_errors(F.col("_found"), error_types).alias("_e"))
        .groupBy(*keys)
        .agg(*_sums(), F.sum("_e").alias("errata_error_count"))
        .withColumns({"score": score, "accuracy_rate": accuracy, "passed": passed})
    )


def entry_scores(
    df: DataFrame, keys: Sequence[str], timing: Column, content: Column, error_types: Sequence[str] = CONTENT_ERROR_TYPES
) -> DataFrame:
    """:func:`timing_score` and :func:`content_score` in one pass of the entries, as
    ``content_score, accuracy_rate, content_passed, timing_score, timing_passed`` and the
    counts ``_cc, _cw, _tc, _tw``. What both families check is evaluated once."""
    counts = {f"_{name}{k[1:]}": v for name, col in (("c", "_content"), ("t", "_timing")) for k, v in _counts(F.col(col)).items()}
    rows = df.select(*keys, timing.alias("_timing"), content.alias("_content"))
    rows = rows.select(*keys, *[v.alias(k) for k, v in counts.items()], _critical_errors(F.col("_content"), error_types).alias("_e"))
    rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(k).alias(k) for k in (*counts, "_e")])
    of_content = _content_result(F.col("_cc"), F.col("_cw"), F.col("_e"), F.col("_n"))
    of_timing = _timing_result(F.col("_tc"), F.col("_tw"))
    names = ("content_score", "accuracy_rate", "content_passed", "timing_score", "timing_passed")
    return rows.select(*keys, *counts, *[v.alias(k) for k, v in zip(names, (*of_content, *of_timing))])


def coverage(df: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Span, covered time and text density of each transcript."""
    length = F.col("end_ms") - F.col("start_ms")
    text_ms, span = F.col("text_ms"), F.col("span_ms")
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_segments"),
            (F.max_by("end_ms", pos) - F.min("start_ms")).alias("span_ms"),
            F.sum(length).alias("text_ms"),
            F.sum(F.length("text")).alias("total_chars"),
        )
        .withColumns(
            {
                "coverage_ratio": F.when(span > 0, text_ms / span).otherwise(F.lit(0.0)),
                "avg_segment_ms": text_ms / F.col("total_segments"),
                "chars_per_s": F.when(text_ms > 0, F.col("total_chars") / (text_ms / 1000)).otherwise(F.lit(0.0)),
            }
        )
    )


def coverage_issues() -> Column:
    from cueline.operators.checks import family, when

    ratio, density = F.col("coverage_ratio"), F.col("chars_per_s")
    return family(
        when(ratio < 0.85, "low_coverage", "warning", ratio),
        when(density > 8, "text_too_dense", "warning", density),
        when(density < 1, "text_too_sparse", "warning", density),
    )


def alignment_report(
    df: DataFrame,
    keys: Sequence[str],
    found: Column | Sequence[Check],
    params: SubtitleParams,
    pos: str = "pos",
) -> DataFrame:
    """Scores of the alignment report, unrounded.

    ``found`` is the alignment family, or the list of its checks, which are then
    counted without issues being made; ``df`` has the previous row's columns.
    One grouped aggregation with map-side partial sums.
    """
    return alignment_scores(alignment_counts(df, keys, found, params, pos), keys, pos)


def alignment_counts(
    df: DataFrame, keys: Sequence[str], found: Column | Sequence[Check], params: SubtitleParams, pos: str = "pos"
) -> DataFrame:
    """What one row adds to the alignment report."""
    gap = F.col("gap_ms")
    if isinstance(found, Column):
        df = df.withColumn("_found", found)
        counts = _counts(F.col("_found")) | {"_timing": type_count(F.col("_found"), TIMING_ERROR_TYPES)}
    else:
        of = lambda severity: how_many([c for c in found if c[2] == severity])
        counts = {"_c": of("critical"), "_w": of("warning"), "_timing": how_many([c for c in found if c[1] in TIMING_ERROR_TYPES])}
    return df.select(
        *keys, pos, "start_ms", "end_ms", F.length("text").alias("_chars"),
        *[v.alias(k) for k, v in counts.items()],
        (gap < 0).cast("int").alias("_overlap"),
        (gap > 2000).cast("int").alias("_large"),
        is_interruption(params).cast("int").alias("_valid"),
    )


def alignment_scores(rows: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """The alignment report of rows from :func:`alignment_counts`."""
    length = F.col("end_ms") - F.col("start_ms")
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_segments"),
        (F.max_by("end_ms", pos) - F.min("start_ms")).alias("span_ms"),
        F.sum(length).alias("text_ms"),
        F.sum("_chars").alias("total_chars"),
        F.sum("_c").alias("critical_count"),
        F.sum("_w").alias("_row_warnings"),
        F.sum("_timing").alias("_timing"),
        F.coalesce(F.sum("_overlap"), F.lit(0)).alias("_overlap"),
        F.coalesce(F.sum("_large"), F.lit(0)).alias("_large"),
        F.sum("_valid").alias("_valid"),
    )
    text_ms, span = F.col("text_ms"), F.col("span_ms")
    agg = agg.withColumns(
        {
            "coverage_ratio": F.when(span > 0, text_ms / span).otherwise(F.lit(0.0)),
            "chars_per_s": F.when(text_ms > 0, F.col("total_chars") / (text_ms / 1000)).otherwise(F.lit(0.0)),
        }
    )
    agg = agg.withColumns(
        {
            "warning_count": F.col("_row_warnings") + F.size(coverage_issues()),
            "coverage_score": F.least(F.lit(100.0), F.col("coverage_ratio") * 100),
            "timing_accuracy_score": _floor0((100 - F.col("_timing") * 5).cast("double")),
            "continuity_score": _floor0((100 - F.col("_overlap") * 10 - F.col("_large")).cast("double")),
            "interruption_quality_score": F.when(
                F.col("_overlap") > 0, F.col("_valid") / F.col("_overlap") * 100
            ).otherwise(F.lit(100.0)),
        }
    )
    c, w, n = F.col("critical_count"), F.col("warning_count"), F.col("total_segments")
    agg = agg.withColumn(
        "alignment_score",
        F.col("coverage_score") * 0.20
        + F.col("timing_accuracy_score") * 0.35
        + F.col("continuity_score") * 0.15
        + F.col("interruption_quality_score") * 0.15
        + (100 - F.least(F.lit(100), c * 5)) * 0.15,
    )
    return agg.select(
        *keys, "total_segments", "critical_count", "warning_count", "coverage_score", "timing_accuracy_score",
        "continuity_score", "interruption_quality_score", "alignment_score",
        (c == 0).alias("passed"),
        (
            (c == 0) & (w <= n * 0.10) & (F.col("alignment_score") >= 85)
            & (F.col("timing_accuracy_score") >= 95) & (F.col("coverage_score") >= 90)
        ).alias("publishing_ready"),
    )


def audio_score(
    issues: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("file_id",), present: str = "present"
) -> DataFrame:
    """max(0, 100 − 15c − 3w) per file of the manifest; an absent file scores 0
    with one critical ``file_not_found``."""
    counts = issues.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "critical").alias("_c"), F.count_if(F.col("severity") == "warning").alias("_w")
    )
    joined = manifest.join(counts, list(keys), "left").withColumns(
        {"_c": F.coalesce("_c", F.lit(0)), "_w": F.coalesce("_w", F.lit(0))}
    )
    here = F.col(present)
    return joined.select(
        *keys,
        F.when(here, F.col("_c")).otherwise(F.lit(1)).alias("critical_count"),
        F.when(here, F.col("_w")).otherwise(F.lit(0)).alias("warning_count"),
        F.when(here, _floor0((100 - 15 * F.col("_c") - 3 * F.col("_w")).cast("double"))).otherwise(F.lit(0.0)).alias("score"),
        (here & (F.col("_c") == 0)).alias("passed"),
    )


def combined_iteration(entries: DataFrame, alignment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0.40 content + 0.35 alignment + 0.25 timing; all must pass. ``entries`` come from
    :func:`entry_scores`, ``alignment`` from :func:`alignment_report`."""
    keys = list(keys)
    a = alignment.select(*keys, "alignment_score", F.col("passed").alias("alignment_passed"), "publishing_ready", F.col("critical_count").alias("_ac"), F.col("warning_count").alias("_aw"))
    rows = entries.join(a, keys)
    return rows.select(
        *keys, "content_score", "timing_score", "alignment_score", "accuracy_rate",
        "content_passed", "timing_passed", "alignment_passed", "publishing_ready",
        (F.col("content_score") * 0.40 + F.col("alignment_score") * 0.35 + F.col("timing_score") * 0.25).alias("total_score"),
        (F.col("_cc") + F.col("_tc") + F.col("_ac")).alias("critical_issues"),
        (F.col("_cw") + F.col("_tw") + F.col("_aw")).alias("warnings"),
    ).withColumn(
        "all_passed",
        F.col("content_passed") & F.col("timing_passed") & F.col("alignment_passed") & (F.col("critical_issues") == 0),
    )


def full_validation(iteration: DataFrame, audio: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0.30 content + 0.20 timing + 0.25 alignment + 0.25 mean audio score.

    Without any audio file the audio part counts 0 and does not fail."""
    keys = list(keys)
    sound = audio.groupBy(*keys).agg(
        F.avg("score").alias("audio_score"), F.bool_and("passed").alias("_apass"), F.sum("critical_count").alias("_acrit")
    )
    rows = iteration.join(sound, keys, "left").withColumns(
        {
            "audio_score": F.coalesce("audio_score", F.lit(0.0)),
            "_apass": F.coalesce("_apass", F.lit(True)),
            "_acrit": F.coalesce("_acrit", F.lit(0)),
        }
    )
    total = F.col("critical_issues") + F.col("_acrit")
    return rows.select(
        *keys,
        (
            F.col("content_score") * 0.30 + F.col("timing_score") * 0.20
            + F.col("alignment_score") * 0.25 + F.col("audio_score") * 0.25
        ).alias("overall_score"),
        (
            F.col("content_passed") & F.col("timing_passed") & F.col("alignment_passed") & F.col("_apass") & (total == 0)
        ).alias("all_passed"),
        total.alias("total_critical_issues"),
    )


def full_validation_advice(content_issues: DataFrame, iteration: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixed texts for what failed, in order; one text if nothing did."""
    keys = list(keys)
    kinds = content_issues.where("severity = 'critical'").groupBy(*keys).agg(F.collect_set("issue_type").alias("_kinds"))
    text = dict(FULL_VALIDATION_TEXTS)
    has = lambda kind: ~F.col("content_passed") & F.array_contains(F.coalesce("_kinds", F.array().cast("array<string>")), kind)
    lines = [F.when(has(k), text[k]) for k in ("traditional_chinese_detected", "errata_violation", "multi_line_subtitle")]
    lines += [F.when(~F.col("timing_passed"), text["timing"]), F.when(~F.col("publishing_ready"), text["alignment"])]
    found = F.array_compact(F.array(*lines))
    return iteration.join(kinds, keys, "left").select(
        *keys, F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(text["clear"]))).alias("recommendations")
    )


def efficiency(summaries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Skip ratio and score; groups without any clip give no row."""
    agg = summaries.groupBy(*keys).agg(
        F.sum("generated").alias("total_generated"), F.sum("skipped").alias("total_skipped")
    )
    g, s = F.col("total_generated"), F.col("total_skipped")
    ratio = s / (g + s)
    return agg.where(g + s > 0).select(
        *keys, "total_generated", "total_skipped", ratio.alias("skip_ratio"),
        F.when((g > 0) & (s == 0), F.lit(100.0)).otherwise(F.least(F.lit(100.0), ratio * 100 + 50)).alias("efficiency_score"),
    )


def style_deductions(files: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """95 less 5, 10 and 5 per ASS file without border box or drawn background,
    font name and scaling flag; not below 0."""
    text = F.col(content)
    boxed = text.contains("BorderStyle,3")
    drawn = text.contains("\\p1}") & text.contains("\\1c&H") & text.contains("\\1a&H")
    lost = (
        F.when(boxed | drawn, 0).otherwise(5)
        + F.when(text.contains("Noto Sans SC"), 0).otherwise(10)
        + F.when(text.contains("ScaledBorderAndShadow"), 0).otherwise(5)
    )
    return files.groupBy(*keys).agg(_floor0((95 - F.sum(lost)).cast("double")).alias("style_score"))


def quality_report(
    versions: DataFrame,
    keys: Sequence[str],
    audio: DataFrame,
    timing: DataFrame,
    content: DataFrame,
    style: DataFrame,
    efficiency_rows: DataFrame,
    penalties: DataFrame | None = None,
) -> DataFrame:
    """One report row per version from per-file and per-version scores.

    Missing audio, timing, content and efficiency count 100, missing style 0.
    ``penalties`` has ``n_penalties`` (semantic and visual issues), each worth 2
    points, at most 10.
    """
    keys = list(keys)
    mean = lambda df, name: df.groupBy(*keys).agg(
        F.avg("score").alias(name), F.sum("critical_count").alias(f"_{name}_c"), F.sum("warning_count").alias(f"_{name}_w")
    )
    rows = (
        versions.join(mean(audio, "audio"), keys, "left")
        .join(mean(timing, "timing"), keys, "left")
        .join(mean(content, "content"), keys, "left")
        .join(style, keys, "left")
        .join(efficiency_rows.select(*keys, "efficiency_score"), keys, "left")
    )
    rows = rows.join(penalties, keys, "left") if penalties is not None else rows.withColumn("n_penalties", F.lit(0))
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    total = lambda s: sum((default(f"_{n}_{s}", 0) for n in ("audio", "timing", "content")), F.lit(0))
    base = (
        default("audio", 100.0) * 0.25
        + (default("timing", 100.0) * 0.4 + default("content", 100.0) * 0.6) * 0.25
        + default("style_score", 0.0) * 0.20
        + default("efficiency_score", 100.0) * 0.20
    )
    lost = F.least(F.lit(10), default("n_penalties", 0) * 2)
    scored = rows.select(
        *keys,
        default("audio", 100.0).alias("audio_score"), default("timing", 100.0).alias("timing_score"),
        default("content", 100.0).alias("content_score"), default("style_score", 0.0).alias("style_score"),
        default("efficiency_score", 100.0).alias("efficiency_score"),
        F.when(lost > 0, _floor0(base - lost)).otherwise(base).alias("overall_score"),
        total("c").alias("critical_count"), total("w").alias("warning_count"),
    )
    return scored.withColumn("passed", (F.col("critical_count") == 0) & (F.col("overall_score") >= 80))


#: Columns of the optional parts of a report and the metrics they become, with the value of a missing row.
REPORT_PARTS = (
    ("alignment_score", "alignment_score", 0.0),
    ("coverage_score", "alignment_coverage_score", 0.0),
    ("timing_accuracy_score", "alignment_timing_accuracy", 0.0),
    ("continuity_score", "alignment_continuity_score", 0.0),
    ("efficiency_score", "generation_efficiency_score", 0.0),
    ("extraction_score", "subtitle_style_extraction_score", 0.0),
    ("vertical_overlay_aspect_compliant", "vertical_overlay_aspect_compliant", True),
    ("vertical_style_completeness", "vertical_style_completeness", 0.0),
    ("loudness_passed", "loudness_normalization_pass", True),
    ("loudness_deviation", "loudness_lufs_deviation", 0.0),
)


def report_metrics(
    issues: DataFrame, entries: DataFrame, audio: DataFrame, style: DataFrame, keys: Sequence[str], parts: Sequence[DataFrame] = ()
) -> DataFrame:
    """Metrics of a report: counts per bucket of issue types and completeness.

    Each issue falls into the first bucket it fits. ``entries`` has
    ``total_entries``, ``audio`` file rows with ``score`` and ``lufs``.
    ``parts`` are tables of one row per key with columns of ``REPORT_PARTS``;
    metrics whose column no part has are left out. Percentages have one digit.
    """
    keys = list(keys)
    kind = F.col("issue_type")
    bucketed = [t for _, types in ISSUE_BUCKETS for t in types]
    counts = issues.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "critical").alias("critical_issue_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        *[F.count_if(kind.isin(*types)).alias(name) for name, types in ISSUE_BUCKETS],
        F.count_if(kind.startswith("word_level_") & (kind != "word_level_filler_sound")).alias("word_level_error_count"),
        F.count_if(kind.isin(*[t for t in ERRATA_TYPES if t not in bucketed])).alias("subtitle_errata_violations"),
        F.count_if(kind == "true_peak_exceeded").alias("audio_tp_violations"),
        F.count_if(kind == "abrupt_start").alias("audio_abrupt_start_count"),
        F.count_if(kind == "abrupt_end").alias("audio_abrupt_end_count"),
        F.count_if(kind.isin(*TRUNCATION_TYPES)).alias("_truncated"),
        F.count_if(kind.isin(*MULTILINE_TYPES)).alias("_multiline"),
        F.count_if(kind.isin(*FILLER_TYPES)).alias("_filler"),
        F.count_if(kind.isin(*FRAGMENT_TYPES)).alias("subtitle_fragment_count"),
    )
    sound = audio.groupBy(*keys).agg(
        F.avg("score").alias("audio_quality_score"),
        (F.sum(F.abs(F.col("lufs") + 14)) / F.count(F.lit(1))).alias("audio_lufs_deviation"),
    )
    rows = entries.join(counts, keys, "left").join(sound, keys, "left").join(style, keys, "left")
    given = {c for part in parts for c in part.columns}
    known = [p for p in REPORT_PARTS if p[0] in given]
    for part in parts:
        rows = rows.join(part.select(*keys, *[c for c, _, _ in known if c in part.columns]), keys, "left")
    n = F.col("total_entries")
    share = lambda c: F.bround(F.when(n > 0, (n - F.coalesce(F.col(c), F.lit(0))) / n * 100).otherwise(F.lit(100.0)), 1)
    counted = [c for c in counts.columns if c not in keys and not c.startswith("_")]
    return rows.select(
        *keys,
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counted],
        F.coalesce("audio_quality_score", F.lit(0.0)).alias("audio_quality_score"),
        F.coalesce("audio_lufs_deviation", F.lit(0.0)).alias("audio_lufs_deviation"),
        share("_truncated").alias("subtitle_semantic_completeness"),
        share("_multiline").alias("subtitle_multiline_compliance"),
        share("_filler").alias("subtitle_filler_cleanup_score"),
        F.coalesce("style_score", F.lit(0.0)).alias("subtitle_style_score"),
        F.coalesce("style_score", F.lit(100.0)).alias("subtitle_visual_bounds_score"),
        F.when(F.coalesce(F.col("style_score"), F.lit(0.0)) > 80, 90).otherwise(60).alias("subtitle_font_size_score"),
        *[F.coalesce(F.col(column), F.lit(missing)).alias(metric) for column, metric, missing in known],
    )


def recommendations(issues: DataFrame, reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Texts for the kinds of issues present, in fixed order.

    ``reports`` has ``style_score``, ``efficiency_score`` and ``errata_violations``.
    Only flags per version are aggregated, not the issues themselves.
    """
    keys = list(keys)
    kind, severity = F.col("issue_type"), F.col("severity")
    serious = severity.isin("critical", "warning")
    flags = issues.groupBy(*keys).agg(
        F.bool_or((severity == "critical") & kind.isin("loudness_out_of_range", "true_peak_exceeded")).alias("loudness"),
        F.bool_or(serious & kind.isin("abrupt_start", "abrupt_end")).alias("abrupt"),
        F.bool_or(serious & kind.isin("duration_too_short", "overlap", "reading_speed_too_fast")).alias("timing"),
        F.bool_or((severity == "warning") & F.lower(kind).contains("breath")).alias("breath"),
        F.bool_or(serious).alias("_any"),
    )
    rows = reports.join(flags, keys, "left")
    off = F.lit(False)
    present = {
        "loudness": F.coalesce("loudness", off), "abrupt": F.coalesce("abrupt", off), "timing": F.coalesce("timing", off),
        "breath": F.coalesce("breath", off), "clear": ~F.coalesce("_any", off),
        "errata": F.col("errata_violations") > 0, "style": F.col("style_score") < 90,
        "efficiency": F.col("efficiency_score") < 90,
    }
    return rows.select(
        *keys,
        F.array_compact(F.array(*[F.when(present[k], text) for k, text in RECOMMENDATIONS])).alias("recommendations"),
    )


def weighted_scorecard(checks: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Σ score · weight, verdict and whether another round is needed.

    ``checks``: keys, ``item``, ``score`` (0–100), ``level`` (veto, major, minor,
    warning or NULL when passed). ``weights``: ``item, weight, veto``. The sum
    is kept relative to the weight of the items present.
    """
    rows = checks.join(weights, "item")
    failed = F.col("level").isNotNull()
    veto = failed & (F.col("veto") | (F.col("level") == "veto"))
    agg = rows.groupBy(*keys).agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("total_score"),
        F.coalesce(F.bool_or(veto), F.lit(False)).alias("vetoed"),
        F.count_if(F.col("level") == "major").alias("majors"),
    )
    total = F.col("total_score")
    return agg.withColumns(
        {
            "verdict": F.when(F.col("vetoed") | (total < 70), "fail").when(total >= 85, "pass").otherwise("conditional"),
            "retry": F.col("vetoed") | (F.col("majors") > 0),
        }
    )


def scenario_scores(rows: DataFrame) -> DataFrame:
    """Delivery score of each scenario: 0.25, 0.20, 0.30, 0.25 of its parts."""
    return rows.withColumn(
        "delivery_score",
        F.when(F.col("workflow_selection_correct"), F.lit(100.0)).otherwise(F.lit(0.0)) * 0.25
        + F.col("parameter_compliance") * 0.20 + F.col("output_completeness") * 0.30 + F.col("quality_compliance") * 0.25,
    )


def scenario_rollup(scenarios: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means over scenarios, share of right workflows, pass at 80/75/80 %."""
    agg = scenarios.groupBy(*keys).agg(
        (F.count_if("workflow_selection_correct") / F.count(F.lit(1)) * 100).alias("workflow_selection_accuracy"),
        *[F.avg(c).alias(c) for c in ("parameter_compliance", "output_completeness", "quality_compliance", "delivery_score")],
        F.count(F.lit(1)).alias("scenario_count"),
        F.count_if(F.col("delivery_score") >= 80).alias("scenarios_passed"),
    )
    return agg.withColumn(
        "passed",
        (F.col("workflow_selection_accuracy") >= 80) & (F.col("delivery_score") >= 75)
        & (F.col("scenarios_passed") >= F.col("scenario_count") * 0.8),
    )


def scenario_comparison(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deltas of the rollup, rounded to 2, with improved and regressed flags."""
    keys = list(keys)
    names = ("workflow_selection_accuracy", "parameter_compliance", "output_completeness", "quality_compliance", "delivery_score", "scenarios_passed")
    b = before.select(*keys, *[F.col(n).alias(f"_b_{n}") for n in names], F.col("passed").alias("passed_before"))
    rows = after.withColumnRenamed("passed", "passed_after").join(b, keys)
    delta = F.col("delivery_score") - F.col("_b_delivery_score")
    return rows.select(
        *keys, *[F.bround(F.col(n) - F.col(f"_b_{n}"), 2).alias(f"{n}_delta") for n in names],
        (delta > 0).alias("improved"), (delta < 0).alias("regressed"), "passed_before", "passed_after",
    )


def missing_files(manifest: DataFrame, clips: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Required file kinds each clip lacks; complete clips have an empty list."""
    keys = list(keys)
    flags = manifest.groupBy(*keys).agg(*[F.bool_or(F.col("kind") == k).alias(f"_has{i}") for i, k in enumerate(required)])
    lacks = [F.when(~F.coalesce(F.col(f"_has{i}"), F.lit(False)), k) for i, k in enumerate(required)]
    missing = F.array_compact(F.array(*lacks))
    return clips.join(flags, keys, "left").select(*keys, missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def series_summary(clips: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Totals per series: a clip with errors counts as skipped."""
    return clips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_clips"),
        F.count_if(F.size("errors") == 0).alias("generated"),
        F.count_if(F.size("errors") > 0).alias("skipped"),
    )


def file_counts(manifest: DataFrame, path: str = "path") -> DataFrame:
    """Files per series and extension, with totals."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return manifest.select("series", ext.alias("extension")).rollup("series", "extension").agg(F.count(F.lit(1)).alias("n"))
