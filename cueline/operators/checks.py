"""Row checks. Each family is one array column of issues, so a family costs one
projection whatever the number of checks, and scores need no exploding.

Checks read ``text`` and two columns that :func:`measured` adds once per row:
``body``, the stripped text, and ``chars``, its counted characters.

An issue is ``(issue_type, severity, value, detail)`` with severity
``critical``, ``warning`` or ``info``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions.text import char_class, counted, speed, strip
from cueline.operators.ordered import over_neighbours
from cueline.operators.rules import (
    ISSUE,
    Rules,
    contextual_hits,
    issue,
    literal_hits,
    mentions_any,
    no_issues,
    regex_hits,
    semantic_hits,
    suspicious_hits,
    tokens,
)
from cueline.operators.timeline import with_previous
from cueline.params import PUBLISHING, AudioParams, SubtitleParams


def when(condition: Column, issue_type: str, severity: str, value: Column | None = None, detail: Column | None = None) -> Column:
    """An array with the issue where the condition holds, else empty."""
    return F.when(condition, F.array(issue(issue_type, severity, value, detail))).otherwise(no_issues())


def each(values: Column, issue_type: str, severity: str, as_value: bool = False) -> Column:
    """One issue per array element."""
    return F.transform(
        values, lambda v: issue(issue_type, severity, v if as_value else None, None if as_value else v)
    )


def family(*parts: Column) -> Column:
    """All issues of several checks, in order."""
    return F.concat(*[p.cast(ISSUE) for p in parts])


Check = tuple[Column, str, str, Column]
"""When an issue is found, its type, its severity and its value."""


def every(checks: Sequence[Check]) -> Column:
    return family(*[when(*check) for check in checks])


def how_many(checks: Sequence[Check]) -> Column:
    """The number of issues of these checks in a row, without an array of them."""
    return sum((F.when(condition, 1).otherwise(0) for condition, *_ in checks), F.lit(0))


def measured(df: DataFrame, params: SubtitleParams) -> DataFrame:
    """Add ``body`` and ``chars``, so that no check evaluates them again."""
    return df.withColumns({"body": strip(F.col("text")), "chars": counted(F.col("text"), params.count_class)})


def _length_ms() -> Column:
    return F.col("end_ms") - F.col("start_ms")


# -- timing of entries ----------------------------------------------------------------


def display_duration(params: SubtitleParams) -> Column:
    length = _length_ms() / 1000
    return family(
        when(length < params.min_display_s, "duration_too_short", "warning", length),
        when(length > params.max_display_s, "duration_too_long", "warning", length),
    )


def reading_speed(params: SubtitleParams) -> Column:
    chars = F.col("chars")
    rate = speed(chars, _length_ms())
    fast = (chars > 0) & (rate > params.reading_speed * 2.0)
    return family(
        when(fast, "reading_speed_too_fast", "critical", rate),
        when((chars > 0) & ~fast & (rate > params.reading_speed * 1.5), "reading_speed_fast", "warning", rate),
    )


def line_shape(params: SubtitleParams) -> Column:
    """Number of lines and counted characters of each line."""
    lines = F.split("text", "\n")
    several = F.transform(lines, lambda t: counted(t, params.count_class))
    lengths = F.when(F.col("text").contains("\n"), several).otherwise(F.array("chars"))
    return family(
        when(F.size(lines) > params.max_lines, "too_many_lines", "warning", F.size(lines)),
        each(F.filter(lengths, lambda n: n > params.max_chars), "line_too_long", "warning", as_value=True),
    )


def gap_to_previous(params: SubtitleParams, previous_end: str = "prev_end_ms") -> Column:
    """Overlap or too small a gap to the previous entry in input order."""
    gap = (F.col("start_ms") - F.col(previous_end)) / 1000
    return family(
        when(F.coalesce(gap < 0, F.lit(False)), "overlap", "critical", gap),
        when(F.coalesce((gap >= 0) & (gap < params.min_gap_s), F.lit(False)), "gap_too_short", "info", gap),
    )


def text_quality(params: SubtitleParams) -> Column:
    body = F.col("body")
    return family(
        when(body == "", "empty_text", "critical"),
        when(F.length(body) > 100, "text_too_long", "warning", F.length(body)),
        when(body.rlike(params.count_class + "{30,}"), "no_punctuation", "warning"),
    )


def overlap_with_next(next_start: str = "next_start_ms") -> Column:
    """End after the next start, in start order; the value is the overlap in seconds,
    the detail the end that would remove it."""
    late = F.coalesce(F.col("end_ms") > F.col(next_start), F.lit(False))
    return when(
        late, "subtitle_overlap", "critical", (F.col("end_ms") - F.col(next_start)) / 1000,
        F.format_string("%.2f", F.col(next_start) / 1000 - 0.04),
    )


def with_entry_context(
    df: DataFrame, keys: Sequence[str], index: str, pos: str | None = None, params: SubtitleParams = SubtitleParams(), width: int = 3, **options
) -> DataFrame:
    """Everything the entry checks look at: previous end and neighbouring text in
    ``index`` order, next start in ``pos`` order. One shuffle if both agree."""
    offsets = range(-width, width + 1)
    same = pos is None or pos == index
    columns: dict[str, Callable] = {"prev_end_ms": lambda w: F.lag("end_ms").over(w)}
    columns |= {f"_t{o + width}": (lambda w, o=o: F.lag("text", -o).over(w)) for o in offsets}
    if same:
        columns["next_start_ms"] = lambda w: F.lead("start_ms").over(w)
    rows = over_neighbours(df, keys, index, columns, before=width, after=width, **options)
    texts = [f"_t{o + width}" for o in offsets]
    rows = rows.withColumn("context", F.concat_ws(" ", *texts)).drop(*texts)
    if not same:
        rows = over_neighbours(
            rows, keys, pos, {"next_start_ms": lambda w: F.lead("start_ms").over(w)}, before=0, after=1, **options
        )
    return measured(rows, params)


def with_segment_context(
    df: DataFrame, keys: Sequence[str], pos: str = "pos", params: SubtitleParams = SubtitleParams(), **options
) -> DataFrame:
    """What the alignment checks look at: the previous end and text in time order."""
    return measured(with_previous(df, keys, pos, **options), params)


def timing_family(params: SubtitleParams, rules: Rules = Rules(), places: bool = True) -> Column:
    """All checks of the timing score, on rows from :func:`with_entry_context`."""
    return family(
        display_duration(params), reading_speed(params), line_shape(params), gap_to_previous(params),
        text_quality(params), word_level(params, rules, places=places), overlap_with_next(),
    )


# -- text of entries ------------------------------------------------------------------


def traditional_characters(characters: str) -> Column:
    if not characters:
        return no_issues()
    cls = char_class(characters)
    found = F.regexp_extract_all(F.col("text"), F.lit(cls), F.lit(0))
    return when(
        F.col("text").rlike(cls), "traditional_chinese_detected", "critical", F.size(found),
        F.array_join(F.slice(found, 1, 5), ""),
    )


def punctuation(params: SubtitleParams) -> Column:
    body = F.col("body")
    chars = F.col("chars")
    return family(
        when(body.rlike("[,.!?;:]"), "english_punctuation", "warning"),
        when((chars > 8) & ~body.rlike(char_class(params.clause_marks)), "no_punctuation", "warning", chars),
    )


def one_line() -> Column:
    return when(F.col("text").contains("\n"), "multi_line_subtitle", "critical", F.size(F.split("text", "\n")))


def entry_length(params: SubtitleParams) -> Column:
    chars = F.col("chars")
    return when(chars > params.max_chars, "line_too_long", "warning", chars)


def fillers(params: SubtitleParams) -> Column:
    body = F.col("body")
    found = [F.regexp_extract_all(body, F.lit(p), F.lit(0)) for p in params.fillers]
    return each(F.concat(*found), "meaningless_filler", "warning") if found else no_issues()


def anomalies(params: SubtitleParams, check_punctuation: bool = False) -> Column:
    """ASCII words outside the common list, and optionally long unbroken runs."""
    body = F.col("body")
    words = F.regexp_extract_all(body, F.lit("[a-zA-Z]{3,}"), F.lit(0))
    rare = F.filter(words, lambda w: ~F.lower(w).isin(*params.common_words))
    parts = [each(rare, "context_anomaly", "warning")]
    if check_punctuation:
        run = body.rlike(params.count_class + "{8,}") & ~body.rlike(char_class(params.clause_marks))
        parts.append(when(run, "context_anomaly", "warning"))
    return family(*parts)


def line_edges(params: SubtitleParams) -> Column:
    body = F.col("body")
    return family(
        when(body.rlike("^" + char_class(params.line_start_forbidden)), "line_start_forbidden", "warning", None, F.left(body, F.lit(1))),
        when(body.rlike(char_class(params.line_end_forbidden) + r"\z"), "line_end_forbidden", "warning", None, F.right(body, F.lit(1))),
    )


def match_positions(text: Column, matches: Column) -> Column:
    """0-based start of every match, matches being in text order and disjoint."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def locate(acc, m):
        at = acc["at"] - 1 + F.instr(F.substring(text, acc["at"], F.length(text)), m)
        return F.struct((at + F.length(m)).alias("at"), F.array_append(acc["found"], at - 1).alias("found"))

    return F.aggregate(matches, start, locate, lambda acc: acc["found"])


def word_patterns(params: SubtitleParams, places: bool = True) -> Column:
    """Stutters, filler sounds and confusable phrases; the value is the position.

    Without ``places`` the issues have neither value nor detail, which is all that
    scores need: finding a position costs a walk over the text per match."""

    def hits(pattern: str, name: str) -> Column:
        if not places:
            return F.array_repeat(issue(f"word_level_{name}", "warning"), F.regexp_count("text", F.lit(pattern)))
        found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
        return F.zip_with(found, match_positions(F.col("text"), found), lambda m, at: issue(f"word_level_{name}", "warning", at, m))

    parts = [hits(pattern, name) for pattern, name in params.word_checks]
    return F.concat(*parts) if parts else no_issues()


def word_corrections(rules: Rules, custom: Sequence[tuple[str, str]]) -> Column:
    """Custom rules inside dictionary words: one issue per (word, rule)."""
    if not custom:
        return no_issues()
    words = F.filter(tokens(F.col("text"), rules.dictionary), lambda w: F.length(w) >= 2)
    hits = F.transform(words, lambda w: literal_hits(w, custom, "word_level_custom_errata"))
    return F.flatten(hits).cast(ISSUE)


def word_disambiguation(rules: Rules, distinct: bool = False) -> Column:
    """Disambiguation rules whose cue is near. Scores count an issue for each word of
    two or more characters of the text, so it is repeated; ``distinct`` gives one."""
    if not rules.disambiguation:
        return no_issues()
    words = F.size(F.filter(tokens(F.col("text"), rules.dictionary), lambda w: F.length(w) >= 2))  # only where a rule hits
    parts = [
        F.when(mentions_any(F.col("context"), cues), literal_hits(F.col("text"), fixes, "word_level_contextual_disambiguation", True))
        for cues, fixes in rules.disambiguation
    ]
    once = F.flatten(F.array_compact(F.array(*parts))).cast(ISSUE)
    repeated = F.when(words > 0, once).otherwise(no_issues()) if distinct else F.flatten(F.array_repeat(once, words))
    return F.when(F.size(once) > 0, repeated).otherwise(no_issues())


def word_level(params: SubtitleParams, rules: Rules = Rules(), custom: Sequence[tuple[str, str]] = (), distinct: bool = False, places: bool = True) -> Column:
    return family(word_corrections(rules, custom), word_disambiguation(rules, distinct), word_patterns(params, places))


def word_level_score(df: DataFrame, params: SubtitleParams, rules: Rules, custom: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Per entry: words, criticals, warnings and max(0, 100 − 10c − 3w)."""
    rows = df.withColumn("_found", word_level(params, rules, custom, places=False))
    rows = rows.withColumns(
        {
            "n_words": F.size(tokens(F.col("text"), rules.dictionary)),
            "critical": severity_count(F.col("_found"), "critical"),
            "warning": severity_count(F.col("_found"), "warning"),
        }
    ).drop("_found")
    return rows.withColumn("word_score", F.greatest(F.lit(0), 100 - 10 * F.col("critical") - 3 * F.col("warning")))


def content_family(
    params: SubtitleParams,
    rules: Rules,
    strip_punctuation: bool = True,
    words: bool = True,
    overlaps: bool = True,
    extra: Sequence[Column] = (),
    places: bool = True,
) -> Column:
    """All checks of the content score, on rows from :func:`with_entry_context`.

    ``extra`` takes further issue arrays of the caller's own."""
    body = F.col("body")
    parts = [traditional_characters("".join(a for a, _ in rules.char_map))]
    if not strip_punctuation:
        parts.append(punctuation(params))
    flat = rules.literal
    parts += [
        one_line(), entry_length(params), literal_hits(F.col("text"), flat),
        F.when(body == "", no_issues()).otherwise(
            family(literal_hits(body, flat, "asr_phonetic_error"), regex_hits(body, rules.regex))
        ),
        semantic_hits(body, rules.semantic),
        fillers(params), anomalies(params, not strip_punctuation), line_edges(params),
        contextual_hits(body, F.col("context"), rules),
    ]
    if words:
        parts.append(word_level(params, rules, places=places))
    if overlaps:
        parts.append(overlap_with_next())
    return family(*parts, *extra)


# -- alignment of segments ------------------------------------------------------------


def segment_duration() -> Column:
    return every(_segment_duration())


def _segment_duration() -> list[Check]:
    length = _length_ms()
    return [
        (length <= 0, "zero_or_negative_duration", "critical", length),
        ((length > 0) & (length < 500), "too_short_segment", "warning", length),
    ]


def continuity() -> Column:
    """Overlap, large and moderate gaps to the previous segment in time order."""
    return every(_continuity())


def _continuity() -> list[Check]:
    gap = F.col("gap_ms")
    known = gap.isNotNull()
    return [
        (known & (gap < 0), "timestamp_overlap", "critical", -gap),
        (known & (gap > 2000), "large_gap", "info", gap),
        (known & (gap > 500) & (gap <= 2000), "moderate_gap", "info", gap),
    ]


def speaking_speed(params: SubtitleParams) -> Column:
    return every(_speaking_speed(params))


def _speaking_speed(params: SubtitleParams) -> list[Check]:
    chars = F.col("chars")
    rate = speed(chars, _length_ms(), 0.0)
    known = (chars > 0) & (_length_ms() > 0)
    return [
        (known & (rate > 12), "impossible_speaking_speed", "critical", rate),
        (known & (rate > 8) & (rate <= 12), "fast_speaking_speed", "warning", rate),
        (known & (rate < 1) & (chars > 3), "slow_speaking_speed", "info", rate),
    ]


def publishing(params: SubtitleParams = PUBLISHING) -> Column:
    return every(_publishing(params))


def _publishing(params: SubtitleParams) -> list[Check]:
    length = _length_ms() / 1000
    chars = F.col("chars")
    rate = speed(chars, _length_ms(), 0.0)
    gap = F.col("gap_ms")
    known = gap.isNotNull()
    return [
        (length < params.min_display_s, "subtitle_too_short", "critical", length),
        (length > params.max_display_s, "subtitle_too_long", "warning", length),
        (chars > params.capacity, "subtitle_text_too_long", "warning", chars),
        (rate > params.max_speed, "reading_speed_exceeded", "warning", rate),
        (known & (gap < -500), "subtitle_overlap", "critical", -gap),
        (known & (gap >= -500) & (gap < 0), "subtitle_minor_overlap", "info", -gap),
    ]


def _interrupting(params: SubtitleParams) -> tuple[Column, Column]:
    """Whether the previous text is incomplete, and whether this one begins with a connective."""
    before, now = strip(F.col("prev_text")), F.col("body")
    pause = char_class(params.clause_marks.translate({ord(c): None for c in params.sentence_end}) or "，、；：")
    incomplete = before.rlike(pause + r"\z") | (
        ~before.rlike(char_class(params.sentence_end) + r"\z") & (F.length(before) > 5)
    )
    return incomplete, now.rlike("^(?:" + "|".join(params.openers) + ")")


def is_interruption(params: SubtitleParams) -> Column:
    """Whether a row overlaps the previous one as an interruption does; texts are looked at where it overlaps."""
    incomplete, connective = _interrupting(params)
    return F.coalesce((F.col("gap_ms") < 0) & (connective | incomplete), F.lit(False))


def interruption(params: SubtitleParams) -> Column:
    """NULL without overlap, else whether and how surely it is an interruption."""
    incomplete, connective = _interrupting(params)
    return F.when(
        F.col("gap_ms") < 0,
        F.struct(
            (-F.col("gap_ms")).alias("overlap_ms"),
            incomplete.alias("prev_incomplete"),
            connective.alias("curr_connective"),
            (incomplete | connective).alias("is_interruption"),
            F.when(incomplete & connective, "high").when(incomplete | connective, "medium").otherwise("low").alias("confidence"),
        ),
    )


def interruptions(df: DataFrame, keys: Sequence[str], params: SubtitleParams, pos: str = "pos") -> DataFrame:
    """Overlapping pairs with their classification; ``df`` has the previous row's columns."""
    rows = df.withColumn("_i", interruption(params)).where("_i is not null")
    return rows.select(
        *keys, F.col(pos).alias("index"), F.col("prev_end_ms"), F.col("start_ms").alias("curr_start_ms"), "_i.*",
        F.left("prev_text", F.lit(50)).alias("prev_text"), F.left("text", F.lit(50)).alias("curr_text"),
    )


def interruption_issues(params: SubtitleParams) -> Column:
    return every(_interruption_issues(params))


def _interruption_issues(params: SubtitleParams) -> list[Check]:
    overlap = -F.col("gap_ms")
    incomplete, connective = _interrupting(params)
    large = F.coalesce((overlap > 500) & ~(connective | incomplete), F.lit(False))
    return [(large, "large_overlap_not_interruption", "warning", overlap)]


def alignment_checks(params: SubtitleParams, standard: SubtitleParams = PUBLISHING) -> list[Check]:
    """All row checks of the alignment report, on rows with the previous row's columns."""
    return [
        *_continuity(), *_segment_duration(), *_speaking_speed(params), *_interruption_issues(params), *_publishing(standard)
    ]


def alignment_family(params: SubtitleParams, standard: SubtitleParams = PUBLISHING) -> Column:
    """:func:`alignment_checks` as one array of issues."""
    return every(alignment_checks(params, standard))


# -- audio measurements ---------------------------------------------------------------


def loudness_compliance(params: AudioParams = AudioParams(), target: Column | None = None, true_peak: Column | None = None) -> Column:
    """Loudness, true peak and range; targets may come from a platform column."""
    wanted = F.lit(params.target_lufs) if target is None else target
    peak = F.lit(params.max_true_peak) if true_peak is None else true_peak
    return family(
        when(F.coalesce(F.abs(F.col("lufs") - wanted) > 2, F.lit(False)), "loudness_out_of_range", "warning", F.col("lufs")),
        when(F.coalesce(F.col("true_peak") > peak, F.lit(False)), "true_peak_exceeded", "critical", F.col("true_peak")),
        when(F.coalesce(F.col("lra") > params.max_lra, F.lit(False)), "lra_too_high", "warning", F.col("lra")),
    )


def clip_sanity(needs_domain: Sequence[str] = (), needs_chapter: Sequence[str] = ()) -> Column:
    """Required clip fields; domain and chapter only for the series that need them."""
    missing = lambda c: F.col(c).isNull()
    in_series = lambda names: F.col("series").isin(*names) if names else F.lit(False)
    return family(
        when(missing("clip_id"), "missing_id", "critical"),
        when(missing("start_ms") | missing("end_ms"), "missing_time", "critical"),
        when(F.coalesce(F.col("end_ms") <= F.col("start_ms"), F.lit(False)), "end_before_start", "critical"),
        *([when(in_series(needs_domain) & missing("domain"), "missing_domain", "warning")] if needs_domain else []),
        *([when(in_series(needs_chapter) & missing("chapter"), "missing_chapter", "warning")] if needs_chapter else []),
    )


# -- using a family -------------------------------------------------------------------


def severity_count(found: Column, severity: str) -> Column:
    return F.size(F.filter(found, lambda i: i["severity"] == severity))


def type_count(found: Column, types: Sequence[str]) -> Column:
    return F.size(F.filter(found, lambda i: i["issue_type"].isin(*types)))


def issues(df: DataFrame, keys: Sequence[str], index: Column, *checks: Column, source: str | None = None) -> DataFrame:
    """The long issues table of one or more families."""
    first = [F.lit(source).alias("source")] if source else []
    return df.select(*keys, index.alias("entry_index"), *first, F.inline(family(*checks)))


def register(df: DataFrame, keys: Sequence[str], index: Column, checks: Sequence[Callable[[], Column]]) -> DataFrame:
    """Issues of a list of check functions; users append their own."""
    return issues(df, keys, index, *[c() for c in checks])


