"""Queries over the row checks. The SQL of each family is reused by the score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.operators import checks, scoring
from cueline.params import LATIN, LATIN_PUBLISHING
from cueline.plans import fixtures as X
from cueline.plans import oracle as O
from cueline.plans.queries_text import CONTEXT, CONTEXTUAL, TOKEN_PATTERN, latin_rules
from cueline.plans.registry import query

KEY = ["transcript_id"]
HEAD = "select transcript_id, seg_idx as entry_index"
BODY = O.strip("text")
N = O.letters("text")
NB = O.letters(BODY)

ENTRIES = """
entries as (
  select *, (end_ms - start_ms) / 1000 as dur, lag(end_ms) over (partition by transcript_id order by seg_idx) as before_ms,
    lead(start_ms) over (partition by transcript_id order by pos) as after_ms from ctx)"""
BASE = (O.SEGMENTS, CONTEXT, ENTRIES)
RATE = f"(case when end_ms > start_ms then {N} / ((end_ms - start_ms) / 1000.0) else 999 end)"


def entries(spark, sf):
    return checks.with_entry_context(X.segments(spark, sf), KEY, "seg_idx", "pos", LATIN)


def found(spark, sf, *families):
    return checks.issues(entries(spark, sf), KEY, F.col("seg_idx"), *families)


def rows(kind: str, severity: str, value: str, detail: str, where: str, source: str = "entries") -> str:
    return f"""{HEAD}, '{kind}' as issue_type, '{severity}' as severity, cast({value} as double) as value, {detail}::varchar as detail
from {source} where {where}"""


def union(*parts: str) -> str:
    return "\nunion all\n".join(parts)


DURATION = union(
    rows("duration_too_short", "warning", "dur", "null", "dur < 1.0"),
    rows("duration_too_long", "warning", "dur", "null", "dur > 7.0"),
)


def speed_rows(standard: float) -> str:
    fast, slow = standard * 2, standard * 1.5
    return union(
        rows("reading_speed_too_fast", "critical", RATE, "null", f"{N} > 0 and {RATE} > {fast}"),
        rows("reading_speed_fast", "warning", RATE, "null", f"{N} > 0 and {RATE} > {slow} and {RATE} <= {fast}"),
    )


SPEED = speed_rows(18)
LINES = union(
    rows("too_many_lines", "warning", "len(string_split(text, chr(10)))", "null", "len(string_split(text, chr(10))) > 1"),
    f"""{HEAD}, 'line_too_long', 'warning', cast(n as double), null from (
  select transcript_id, seg_idx, {O.letters('line')} as n from (
    select transcript_id, seg_idx, unnest(string_split(text, chr(10))) as line from entries)) where n > 42""",
)
GAPS = union(
    rows("overlap", "critical", "(start_ms - before_ms) / 1000", "null", "start_ms < before_ms"),
    rows("gap_too_short", "info", "(start_ms - before_ms) / 1000", "null", "start_ms >= before_ms and (start_ms - before_ms) / 1000 < 0.067"),
)
QUALITY = union(
    rows("empty_text", "critical", "null", "null", f"{BODY} = ''"),
    rows("text_too_long", "warning", f"length({BODY})", "null", f"length({BODY}) > 100"),
    rows("no_punctuation", "warning", "null", "null", f"regexp_matches({BODY}, '[A-Za-z]{{30,}}')"),
)
OVERLAP = rows(
    "subtitle_overlap", "critical", "(end_ms - after_ms) / 1000", "printf('%.2f', after_ms / 1000 - 0.04)", "end_ms > after_ms"
)
ACCENTED = "[" + "".join(a for a, _ in X.ACCENTS) + "]"
CHARACTERS = rows(
    "traditional_chinese_detected", "critical", f"len(regexp_extract_all(text, '{ACCENTED}'))",
    f"array_to_string(regexp_extract_all(text, '{ACCENTED}')[1:5], '')", f"regexp_matches(text, '{ACCENTED}')",
)
PUNCTUATION = union(
    rows("english_punctuation", "warning", "null", "null", f"regexp_matches({BODY}, '[,.!?;:]')"),
    rows("no_punctuation", "warning", NB, "null", f"{NB} > 8 and not regexp_matches({BODY}, '[,.!?;:]')"),
)
ONE_LINE = rows("multi_line_subtitle", "critical", "len(string_split(text, chr(10)))", "null", "contains(text, chr(10))")
LENGTH = rows("line_too_long", "warning", N, "null", f"{N} > 42")


def _all(pattern: str, kind: str) -> str:
    return f"""{HEAD}, '{kind}', 'warning', null::double, m from (
  select transcript_id, seg_idx, unnest(regexp_extract_all({BODY}, '{pattern}')) as m from entries)"""


FILLERS = union(*[_all(p, "meaningless_filler") for p in LATIN.fillers])
COMMON = ", ".join(O.quote(w) for w in LATIN.common_words)
ANOMALIES = _all("[a-zA-Z]{3,}", "context_anomaly") + f" where lower(m) not in ({COMMON})"
EDGES = union(
    rows("line_start_forbidden", "warning", "null", f"substr({BODY}, 1, 1)", f"regexp_matches({BODY}, '^[eaoE]')"),
    rows("line_end_forbidden", "warning", "null", f"substr({BODY}, length({BODY}), 1)", f"regexp_matches({BODY}, '[nts]$')"),
)


def _located(pattern: str, kind: str) -> str:
    """Matches with their place: the pieces between matches give the offsets."""
    return f"""{HEAD}, 'word_level_{kind}', 'warning', cast(list_sum(list_transform(pieces[1:k], lambda p: length(p)))
    + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) as double), hits[k] from (
  select *, unnest(range(1, len(hits) + 1)) as k from (
    select transcript_id, seg_idx, regexp_extract_all(text, '{pattern}') as hits, regexp_split_to_array(text, '{pattern}') as pieces from entries))"""


STUTTER = f"""{HEAD}, 'word_level_repeat_stutter', 'warning', cast(min(i) - 1 as double), string_agg(c, '') from (
  select *, i - row_number() over (partition by transcript_id, seg_idx, c order by i) as run from (
    select transcript_id, seg_idx, i, substr(text, i, 1) as c from (
      select transcript_id, seg_idx, text, unnest(range(1, length(text) + 1)) as i from entries)))
group by transcript_id, seg_idx, c, run having count(*) >= 3"""
WORDS = union(STUTTER, _located("[a-z]er", "filler_sound"), _located("th[aeo]", "asr_confusion"))
CUSTOM = (("ent", "end"), ("he", "she"), ("tion", "sion"))
WORD_RULES = f"""{HEAD}, 'word_level_custom_errata' as issue_type, 'critical' as severity, null::double as value, wrong || '→' || correct as detail
from (select transcript_id, seg_idx, unnest(regexp_extract_all(text, '(?s){TOKEN_PATTERN}|.')) as w from entries)
join (values {', '.join(f"('{a}', '{b}')" for a, b in CUSTOM)}) r(wrong, correct) on length(w) > 1 and contains(w, wrong)"""
_MULTI = f"len(list_filter(regexp_extract_all(text, '(?s){TOKEN_PATTERN}|.'), lambda t: length(t) > 1))"
WORD_CUES = union(
    *[
        f"""{HEAD}, 'word_level_contextual_disambiguation', 'critical', null::double, {O.quote(w + '→' + c)}
from (select *, unnest(range({_MULTI})) as copy from entries) where contains(text, {O.quote(w)}) and not contains(text, {O.quote(c)})
  and ({' or '.join(f"contains(context, {O.quote(q)})" for q in cues)})"""
        for cues, fixes in X.DISAMBIGUATION
        for w, c in fixes
    ]
)
ERRATA = f"""{HEAD}, 'errata_violation', 'critical', null::double, wrong || '→' || correct from entries join rules on contains(text, wrong)"""
ASR = union(
    f"{HEAD}, 'asr_phonetic_error', 'critical', null::double, wrong || '→' || correct from entries join rules on contains({BODY}, wrong) where {BODY} <> ''",
    f"""{HEAD}, 'asr_phonetic_error', 'critical', null, regexp_extract({BODY}, pattern) || '→' || replacement
from entries join patterns on regexp_matches({BODY}, pattern)""",
)
SEMANTIC = f"""{HEAD}, 'semantic_anomaly', 'critical', null::double, pattern || '→' || correction
from entries join semantic on correction is not null and regexp_matches({BODY}, pattern)"""
RULE_TABLES = (
    O.RULES, O.values("patterns", "pattern, replacement", X.REGEX_RULES),
    O.values("semantic", "pattern, correction, description", X.SEMANTIC_RULES),
)
TIMING = union(DURATION, SPEED, LINES, GAPS, QUALITY, WORD_CUES, WORDS, OVERLAP)
CONTENT = union(
    CHARACTERS, ONE_LINE, LENGTH, ERRATA, ASR, SEMANTIC, FILLERS, ANOMALIES, EDGES, CONTEXTUAL, WORD_CUES, WORDS, OVERLAP
)


def timing(spark):
    return checks.timing_family(LATIN, latin_rules(spark))


def content(spark):
    return checks.content_family(LATIN, latin_rules(spark))


def named(sql: str) -> str:
    return f"select * from ({sql}) t(transcript_id, entry_index, issue_type, severity, value, detail)"


def _register(name, sql, *families, extra=()):
    @query(name, O.with_(*BASE, *extra) + named(sql))
    def run(spark, sf):
        return found(spark, sf, *[f(spark) if callable(f) else f for f in families])

    return run


_register("display_duration_issues", DURATION, lambda s: checks.display_duration(LATIN))
_register("reading_speed_issues", speed_rows(10), lambda s: checks.reading_speed(LATIN.with_values(reading_speed=10.0)))
_register("gap_issues", GAPS, lambda s: checks.gap_to_previous(LATIN))
_register("text_quality_issues", QUALITY, lambda s: checks.text_quality(LATIN))
_register("overlap_issues", OVERLAP, lambda s: checks.overlap_with_next())
_register("traditional_character_issues", CHARACTERS, lambda s: checks.traditional_characters("".join(a for a, _ in X.ACCENTS)))
_register("punctuation_issues", PUNCTUATION, lambda s: checks.punctuation(LATIN))
_register("entry_length_issues", LENGTH, lambda s: checks.entry_length(LATIN))
_register("filler_issues", FILLERS, lambda s: checks.fillers(LATIN))
_register("context_anomaly_issues", ANOMALIES, lambda s: checks.anomalies(LATIN))
_register("line_edge_issues", EDGES, lambda s: checks.line_edges(LATIN))
_register("word_pattern_issues", WORDS, lambda s: checks.word_patterns(LATIN))
_register("word_correction_issues", WORD_RULES, lambda s: checks.word_corrections(latin_rules(s), CUSTOM))
_register("word_disambiguation_issues", WORD_CUES, lambda s: checks.word_disambiguation(latin_rules(s)))
_register("word_level_issues", union(WORD_RULES, WORD_CUES, WORDS), lambda s: checks.word_level(LATIN, latin_rules(s), CUSTOM))
_register("timing_issues", TIMING, timing)
_register("content_issues", CONTENT, content, extra=RULE_TABLES)


@query("word_level_scores", O.with_(*BASE, f"w as ({union(WORD_RULES, WORD_CUES, WORDS)})") + f""",
c as (select transcript_id, entry_index, count(*) filter (severity = 'critical') as c, count(*) filter (severity = 'warning') as w from w group by all)
select transcript_id, seg_idx, len(regexp_extract_all(text, '(?s){TOKEN_PATTERN}|.')) as n_words,
  greatest(0, 100 - 10 * coalesce(c, 0) - 3 * coalesce(w, 0)) as word_score
from entries left join c using (transcript_id) where entry_index is not distinct from seg_idx
union all select transcript_id, seg_idx, len(regexp_extract_all(text, '(?s){TOKEN_PATTERN}|.')), 100 from entries e
where not exists (select 1 from c where c.transcript_id = e.transcript_id and c.entry_index = e.seg_idx)""")
def word_level_scores(spark, sf):
    rows = checks.word_level_score(entries(spark, sf), LATIN, latin_rules(spark), CUSTOM)
    return rows.select("transcript_id", "seg_idx", F.col("n_words").cast("long").alias("n_words"), F.col("word_score").cast("long").alias("word_score"))


@query("registered_checks", O.with_(*BASE) + union(DURATION, EDGES))
def registered_checks(spark, sf):
    chosen = [lambda: checks.display_duration(LATIN), lambda: checks.line_edges(LATIN)]
    return checks.register(entries(spark, sf), KEY, F.col("seg_idx"), chosen)


# -- alignment ------------------------------------------------------------------------

AHEAD = "select transcript_id, pos as entry_index"


def arow(kind: str, severity: str, value: str, where: str) -> str:
    return f"{AHEAD}, '{kind}' as issue_type, '{severity}' as severity, cast({value} as double) as value from sorted where {where}"


LEN = "(end_ms - start_ms)"
ARATE = f"({NB} / ({LEN} / 1000.0))"
CONTINUITY = union(
    arow("timestamp_overlap", "critical", "-gap_ms", "gap_ms < 0"),
    arow("large_gap", "info", "gap_ms", "gap_ms > 2000"),
    arow("moderate_gap", "info", "gap_ms", "gap_ms > 500 and gap_ms <= 2000"),
)
VALIDITY = union(
    arow("zero_or_negative_duration", "critical", LEN, f"{LEN} <= 0"),
    arow("too_short_segment", "warning", LEN, f"{LEN} > 0 and {LEN} < 500"),
)
SPEAKING = union(
    arow("impossible_speaking_speed", "critical", ARATE, f"{NB} > 0 and {LEN} > 0 and {ARATE} > 12"),
    arow("fast_speaking_speed", "warning", ARATE, f"{NB} > 0 and {LEN} > 0 and {ARATE} > 8 and {ARATE} <= 12"),
    arow("slow_speaking_speed", "info", ARATE, f"{NB} > 3 and {LEN} > 0 and {ARATE} < 1"),
)
PUBLISHING = union(
    arow("subtitle_too_short", "critical", f"{LEN} / 1000", f"{LEN} < 1000"),
    arow("subtitle_too_long", "warning", f"{LEN} / 1000", f"{LEN} > 7000"),
    arow("subtitle_text_too_long", "warning", NB, f"{NB} > 84"),
    arow("reading_speed_exceeded", "warning", ARATE, f"{LEN} > 0 and {ARATE} > 27"),
    arow("subtitle_overlap", "critical", "-gap_ms", "gap_ms < -500"),
    arow("subtitle_minor_overlap", "info", "-gap_ms", "gap_ms >= -500 and gap_ms < 0"),
)
_BEFORE = O.strip("prev_text")
INCOMPLETE = f"""(regexp_matches({_BEFORE}, '[,;:]$') or (not regexp_matches({_BEFORE}, '[。！？.!?]$') and length({_BEFORE}) > 5))"""
CONNECTIVE = f"regexp_matches({BODY}, '^(On|En|La|The|Die)')"
INTERRUPTED = arow(
    "large_overlap_not_interruption", "warning", "-gap_ms", f"gap_ms < -500 and not {INCOMPLETE} and not {CONNECTIVE}"
)
ALIGNMENT = union(CONTINUITY, VALIDITY, SPEAKING, INTERRUPTED, PUBLISHING)


def sorted_rows(spark, sf, open_lines=False):
    source = X.open_segments(spark, sf) if open_lines else X.segments(spark, sf)
    return checks.with_segment_context(source, KEY, "pos", LATIN)


def _aligned(name, sql, family, open_lines=False):
    @query(name, O.with_(O.OPEN_SEGMENTS if open_lines else O.SEGMENTS, O.SORTED) + sql)
    def run(spark, sf):
        return checks.issues(sorted_rows(spark, sf, open_lines), KEY, F.col("pos"), family()).drop("detail")

    return run


_aligned("continuity_issues", CONTINUITY, checks.continuity)
_aligned("segment_duration_issues", VALIDITY, checks.segment_duration, True)
_aligned("speaking_speed_issues", SPEAKING, lambda: checks.speaking_speed(LATIN))
_aligned("publishing_issues", PUBLISHING, lambda: checks.publishing(LATIN_PUBLISHING))


@query("interruption_issues", O.with_(O.SEGMENTS, O.SORTED.replace("sorted as", "in_order as")) + f""",
sorted as (select * replace (gap_ms - 400 * (pos % 2) as gap_ms) from in_order)
{INTERRUPTED}""")
def interruption_issues(spark, sf):
    """Every other line starts 400 ms earlier, so that large overlaps occur."""
    rows = sorted_rows(spark, sf).withColumn("gap_ms", F.col("gap_ms") - 400 * (F.col("pos") % 2))
    return checks.issues(rows, KEY, F.col("pos"), checks.interruption_issues(LATIN)).drop("detail")


_DOC = "select doc_id, '{}' as issue_type, '{}' as severity, cast({} as double) as value from {} where {}"
_LINES_OF = "len(string_split(text, chr(10)))"


@query("single_line_issues", _DOC.format("multi_line_subtitle", "critical", _LINES_OF, "documents", "contains(text, chr(10))"))
def single_line_issues(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.inline(checks.one_line())).drop("detail")


@query("line_shape_issues", union(
    _DOC.format("too_many_lines", "warning", _LINES_OF, "documents", f"{_LINES_OF} > 1"),
    _DOC.format("line_too_long", "warning", O.letters("line"), "(select doc_id, unnest(string_split(text, chr(10))) as line from documents)", f"{O.letters('line')} > 42"),
))
def line_shape_issues(spark, sf):
    rows = checks.measured(X.table(spark, sf, "documents").select("doc_id", "text"), LATIN)
    return rows.select("doc_id", F.inline(checks.line_shape(LATIN))).drop("detail")


_aligned("alignment_issues", ALIGNMENT, lambda: checks.alignment_family(LATIN, LATIN_PUBLISHING))


@query("interruptions", O.with_(O.SEGMENTS, O.SORTED) + f"""
select transcript_id, pos as index, prev_end_ms, start_ms as curr_start_ms, -gap_ms as overlap_ms, {INCOMPLETE} as prev_incomplete,
  {CONNECTIVE} as curr_connective, {INCOMPLETE} or {CONNECTIVE} as is_interruption,
  case when {INCOMPLETE} and {CONNECTIVE} then 'high' when {INCOMPLETE} or {CONNECTIVE} then 'medium' else 'low' end as confidence,
  substr(prev_text, 1, 50) as prev_text, substr(text, 1, 50) as curr_text from sorted where gap_ms < 0""")
def interruptions(spark, sf):
    return checks.interruptions(sorted_rows(spark, sf), KEY, LATIN)


# -- clips and files ------------------------------------------------------------------

_KINDS = ("video", "audio", "ass", "srt", "metadata", "copyright", "cards", "summary")
_FAULTY = """
given as (
  select transcript_id, case when transcript_id % 17 = 3 then null else clip_id end as clip_id, series,
    case when transcript_id % 13 = 5 then null else start_ms end as start_ms,
    case when transcript_id % 11 = 2 then start_ms else end_ms end as end_ms,
    case when transcript_id % 3 = 0 then 'literature' end as domain, case when transcript_id % 2 = 0 then 'one' end as chapter,
    clip_no from clips)"""


def faulty_clips(spark, sf):
    t = F.col("transcript_id")
    return X.clips(spark, sf).withColumns(
        {
            "clip_id": F.when(t % 17 != 3, F.col("clip_id")),
            "end_ms": F.when(t % 11 == 2, F.col("start_ms")).otherwise(F.col("end_ms")),
            "start_ms": F.when(t % 13 != 5, F.col("start_ms")),
            "domain": F.when(t % 3 == 0, "literature"),
            "chapter": F.when(t % 2 == 0, "one"),
        }
    )


@query("clip_sanity", O.with_(O.SEGMENTS, O.CLIPS, _FAULTY) + """
select transcript_id, clip_no as entry_index, 'missing_id' as issue_type, 'critical' as severity from given where clip_id is null
union all select transcript_id, clip_no, 'missing_time', 'critical' from given where start_ms is null or end_ms is null
union all select transcript_id, clip_no, 'end_before_start', 'critical' from given where end_ms <= start_ms
union all select transcript_id, clip_no, 'missing_domain', 'warning' from given where series = 'deep' and domain is null
union all select transcript_id, clip_no, 'missing_chapter', 'warning' from given where series = 'highlights' and chapter is null""")
def clip_sanity(spark, sf):
    family = checks.clip_sanity(needs_domain=["deep"], needs_chapter=["highlights"])
    return checks.issues(faulty_clips(spark, sf), KEY, F.col("clip_no"), family).drop("value", "detail")


def manifest(spark, sf):
    """Files present per clip: every kind but those a rule of the ids leaves out."""
    kinds = F.posexplode(F.array(*map(F.lit, _KINDS))).alias("kind_no", "kind")
    rows = X.clips(spark, sf).select("transcript_id", "clip_id", "series", "clip_no", kinds)
    return rows.where((F.col("transcript_id") * 7 + F.col("clip_no") * 3 + F.col("kind_no")) % 9 != 0)


MANIFEST = f"""
manifest as (
  select transcript_id, clip_id, series, clip_no, kind_no, kind from clips, (values {', '.join(f"({i}, '{k}')" for i, k in enumerate(_KINDS))}) k(kind_no, kind)
  where (transcript_id * 7 + clip_no * 3 + kind_no) % 9 <> 0)"""


@query("missing_files", O.with_(O.SEGMENTS, O.CLIPS, MANIFEST) + f""",
wanted as (select c.transcript_id, c.clip_id, k.kind_no, k.kind, m.kind as have from clips c
  cross join (values {', '.join(f"({i}, '{k}')" for i, k in enumerate(_KINDS))}) k(kind_no, kind)
  left join manifest m on m.transcript_id = c.transcript_id and m.clip_id = c.clip_id and m.kind = k.kind)
select transcript_id, clip_id, coalesce(string_agg(kind, ',' order by kind_no) filter (have is null), '') as missing,
  count(*) filter (have is null) = 0 as complete from wanted group by transcript_id, clip_id""")
def missing_files(spark, sf):
    rows = scoring.missing_files(manifest(spark, sf), X.clips(spark, sf), ["transcript_id", "clip_id"], _KINDS)
    return rows.withColumn("missing", F.array_join("missing", ","))
