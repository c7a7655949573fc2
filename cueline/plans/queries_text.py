"""Queries over text functions and rule tables. Most read whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.functions import text as txt
from cueline.functions import timecode
from cueline.operators import rules, timeline
from cueline.operators.rules import Rules
from cueline.params import LATIN
from cueline.plans import fixtures as X
from cueline.plans import oracle as O
from cueline.plans.registry import query
from cueline.session import spread

KEY = ["transcript_id"]


def latin_rules(spark) -> Rules:
    """The rule set of the registered queries; the literal part comes from the table."""
    flat = rules.inline_rules(rules.flatten_rules(X.rule_table(spark)))
    return Rules(
        literal=tuple(flat),
        regex=X.REGEX_RULES,
        semantic=X.SEMANTIC_RULES,
        keywords=X.KEYWORDS,
        disambiguation=X.DISAMBIGUATION,
        dictionary=X.DICTIONARY,
        char_map=X.ACCENTS,
        variants=(("eaueau", "eau"),),
        phonetic=(("schsch", "sch"), ("erere", "ere")),
    )


def documents(spark, sf):
    return spread(X.table(spark, sf, "documents"))


def stripped(spark, sf):
    return documents(spark, sf).withColumn("body", txt.strip(F.col("text")))


@query("flattened_rules", """
with given(category, rule_order, wrong, correct) as (values """ + ", ".join(
    f"({O.quote(c)}, {i}, {O.quote(w)}, {O.quote(r)})" for i, (c, w, r) in enumerate(X.LITERAL_RULES)
) + """), ranked as (select *, list_position(['authors', 'works', 'idioms', 'common', 'variants', 'asr_phonetic', 'asr_noise'], category) as rank from given),
flat as (select wrong, arg_max(correct, rank * 1000 + rule_order) as correct from ranked group by wrong)
select wrong, correct, count(*) as n_documents from flat join documents on contains(text, wrong) group by wrong, correct""")
def flattened_rules(spark, sf):
    pairs = latin_rules(spark).literal
    hits = documents(spark, sf).select(F.explode(rules.literal_hits(F.col("text"), pairs)).alias("i"))
    wrong = F.split("i.detail", "→")
    return hits.groupBy(wrong[0].alias("wrong"), wrong[1].alias("correct")).agg(F.count(F.lit(1)).alias("n_documents"))


@query("character_counts", f"""
select doc_id, {O.letters('text')} as counted, length(regexp_replace(text, '[^éèêç]', '', 'g')) as accented from documents""")
def character_counts(spark, sf):
    return documents(spark, sf).select(
        "doc_id", txt.counted(F.col("text"), "[A-Za-z]").cast("long").alias("counted"),
        txt.counted(F.col("text"), "[éèêç]").cast("long").alias("accented"),
    )


@query("reading_rate", O.with_(O.SEGMENTS) + f"""
select transcript_id, seg_idx, case when end_ms > start_ms then {O.letters('text')} / ((end_ms - start_ms) / 1000.0) else 999 end as chars_per_s from segments""")
def reading_rate(spark, sf):
    rate = txt.speed(txt.counted(F.col("text"), LATIN.count_class), F.col("end_ms") - F.col("start_ms"))
    return X.segments(spark, sf).select("transcript_id", "seg_idx", rate.alias("chars_per_s"))


_FROM, _TO = "".join(a for a, _ in X.ACCENTS), "".join(b for _, b in X.ACCENTS)


@query("mapped_characters", f"select doc_id, translate(text, '{_FROM}', '{_TO}') as text from documents")
def mapped_characters(spark, sf):
    return documents(spark, sf).select("doc_id", txt.map_characters(F.col("text"), X.ACCENTS).alias("text"))


@query("protected_replacement", """
select doc_id, replace(replace(replace(replace(replace(text, 'tion', chr(57344)), 'nion', chr(57345)), 'ion', 'yon'), chr(57344), 'tion'), chr(57345), 'nion') as text
from documents""")
def protected_replacement(spark, sf):
    return documents(spark, sf).select("doc_id", txt.replace_except(F.col("text"), "ion", "yon", ["tion", "nion"]).alias("text"))


_MARKED = "replace(replace(text, 'the', '著'), 'ent', '著名')"


@query("short_normalised", f"""
select doc_id, replace(replace(replace(translate({_MARKED}, '{_FROM}', '{_TO}'), '著名', chr(57344)), '著', '着'), chr(57344), '著名') as text from documents""")
def short_normalised(spark, sf):
    """Character map, then 著 to 着 outside its compounds, on texts that hold both."""
    text = F.replace(F.replace("text", F.lit("the"), F.lit("著")), F.lit("ent"), F.lit("著名"))
    return documents(spark, sf).select("doc_id", txt.normalise_short(text, X.ACCENTS).alias("text"))


_FLAT = O.flat_rules()


@query("literal_corrections", f"select doc_id, {O.replaced('text', _FLAT)} as text from documents")
def literal_corrections(spark, sf):
    return documents(spark, sf).select("doc_id", rules.apply_literal(F.col("text"), latin_rules(spark).literal).alias("text"))


_LONGEST = sorted(_FLAT, key=lambda r: -len(r[0]))
_REGEX_SQL = "regexp_replace(regexp_replace(regexp_replace({}, 'tion(tion)+', 'tion', 'g'), '([aeiou])q', '\\1k', 'g'), 'ment(er|en)', 'ment', 'g')"


@query("regex_corrections", "select doc_id, " + _REGEX_SQL.format("text") + " as text from documents")
def regex_corrections(spark, sf):
    return documents(spark, sf).select("doc_id", rules.apply_regex(F.col("text"), X.REGEX_RULES).alias("text"))


@query("fixpoint_corrections", "select doc_id, " + _REGEX_SQL.format(O.replaced("text", _LONGEST * 3)) + " as text from documents")
def fixpoint_corrections(spark, sf):
    pairs = latin_rules(spark).literal
    return documents(spark, sf).select("doc_id", rules.apply_to_fixpoint(F.col("text"), pairs, X.REGEX_RULES).alias("text"))


_PHONETIC = [("schsch", "sch"), ("erere", "ere")]
_NORMAL = "replace(" + _REGEX_SQL.format(
    O.replaced(O.replaced(O.replaced(f"translate(text, '{_FROM}', '{_TO}')", [("eaueau", "eau")]), _FLAT), _PHONETIC * 3)
) + ", '著', '着')"


@query("normalised_text", f"select doc_id, {_NORMAL} as text from documents")
def normalised_text(spark, sf):
    return documents(spark, sf).select("doc_id", rules.normalise(F.col("text"), latin_rules(spark)).alias("text"))


_CLEAN = "regexp_replace(regexp_replace({}, '[\\s\\x0b]+', '', 'g'), '^[,.!?;:]+', '')"


@query("cleaned_text", "select doc_id, " + _CLEAN.format("text") + " as text from documents")
def cleaned_text(spark, sf):
    return documents(spark, sf).select("doc_id", txt.clean(F.col("text"), LATIN.clause_marks).alias("text"))


@query("single_line_text", "select doc_id, replace(text, chr(10), '') as text from documents")
def single_line_text(spark, sf):
    return documents(spark, sf).select("doc_id", txt.single_line(F.col("text")).alias("text"))


_NEXT = """
nexts as (
  select *, (end_ms - start_ms) / 1000 as duration_s, coalesce(next_text, '') as following,
    coalesce(next_start_ms - end_ms, 0) / 1000 as gap_s, next_start_ms is null as is_last from sorted)"""


def _punctuated(text: str) -> str:
    t = O.strip(text)
    return f"""(case when {t} = '' or regexp_matches({t}, '[。！？；：，、,.!?;:]$') then {t}
      when regexp_matches({t}, '(en|er|qui)$') then {t} || '？' when regexp_matches({t}, '(on|st)$') then {t} || '！'
      when is_last or gap_s > 1.5 then {t} || '。'
      when following like 'Les%' then {t} || (case when duration_s > 4 then '。' else '，' end)
      when following like 'Le%' or following like 'In%' or following like 'Das%' then {t} || '，'
      when duration_s > 4 then {t} || '。' else {t} || '，' end)"""


def _fitted(text: str, limit: str) -> str:
    upto = f"length(regexp_extract(substr({text}, 1, {limit} + 3), '(?s)^(.*[,.!?;:])', 1))"
    return f"(case when length({text}) <= {limit} then {text} when {upto} > 0 and {upto} <= {limit} then substr({text}, 1, {upto}) else substr({text}, 1, {limit}) end)"


@query("smart_punctuation", O.with_(O.OPEN_SEGMENTS, O.SORTED, _NEXT) + f"select transcript_id, seg_idx, {_punctuated('text')} as text from nexts")
def smart_punctuation(spark, sf):
    rows = timeline.with_next(X.open_segments(spark, sf), KEY)
    text = txt.smart_punctuation(
        F.col("text"), F.col("next_text"), (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("next_gap_ms") / 1000, F.col("is_last"), LATIN
    )
    return rows.select("transcript_id", "seg_idx", text.alias("text"))


@query("fitted_lines", O.with_(O.SEGMENTS) + f""", c as (select transcript_id, seg_idx, {_CLEAN.format("replace(text, chr(10), '')")} as t from segments)
select transcript_id, seg_idx, {_fitted('t', '42')} as text from c""")
def fitted_lines(spark, sf):
    return X.segments(spark, sf).select("transcript_id", "seg_idx", txt.fit_line(F.col("text"), 42, LATIN.clause_marks).alias("text"))


_BARE = "regexp_replace({}, '[，。！？；：、\"''（）【】《》—…·,.!?;:()\\[\\]{{}}<>–-]', '', 'g')"


@query("display_punctuation_removed", "select doc_id, " + _BARE.format("text") + " as text from documents")
def display_punctuation_removed(spark, sf):
    return documents(spark, sf).select("doc_id", txt.strip_display_punctuation(F.col("text")).alias("text"))


@query("display_text", O.with_(O.SEGMENTS, O.SORTED, _NEXT) + f""",
c1 as (select *, {_CLEAN.format('text')} as t1 from nexts), c2 as (select *, {_punctuated('t1')} as t2 from c1),
c3 as (select *, {_CLEAN.format("replace(t2, chr(10), '')")} as t3,
  case when duration_s > 0 then least(42, greatest(4, cast(trunc(duration_s * 4) as int))) else 42 end as lim from c2)
select transcript_id, seg_idx, {_BARE.format(_fitted('t3', 'lim'))} as text from c3""")
def display_text(spark, sf):
    rows = timeline.with_next(X.segments(spark, sf), KEY)
    text = txt.display_text(
        F.col("text"), F.col("next_text"), (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("next_gap_ms") / 1000, F.col("is_last"), LATIN
    )
    return rows.select("transcript_id", "seg_idx", text.alias("text"))


@query("pixel_widths", """
with n as (select doc_id, length(text) as l, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) as a,
  length(regexp_replace(text, '[^ ]', '', 'g')) as b, length(regexp_replace(text, '[^一-鿿　-〿＀-￯]', '', 'g')) as w from documents)
select doc_id, w * 40 + a * 22 + b * 12 + (l - w - a - b) * 24 as pixels, w * 40 + a * 22 + b * 12 + (l - w - a - b) * 24 > 1632 as too_wide from n""")
def pixel_widths(spark, sf):
    text = F.col("text")
    return documents(spark, sf).select(
        "doc_id", txt.pixel_width(text, 60).cast("long").alias("pixels"), txt.wider_than_frame(text, 60, 1920).alias("too_wide")
    )


@query("stripped_full_stop", "select doc_id, case when text like '%.' then substr(text, 1, length(text) - 1) else text end as text from documents")
def stripped_full_stop(spark, sf):
    return documents(spark, sf).select("doc_id", txt.strip_full_stop(F.col("text"), ".").alias("text"))


@query("ellipsis_titles", "select doc_id, case when length(text) > 20 then substr(text, 1, 20) || '...' else text end as title from documents")
def ellipsis_titles(spark, sf):
    return documents(spark, sf).select("doc_id", txt.ellipsis(F.col("text"), 20).alias("title"))


_MARK = "[，。！？、；：“”‘’（）\\s,]"


def laid_out(cap: int, rows: str, kept: str, mark: str) -> str:
    """Tables and the final select that lay the ``text`` of ``rows`` on two lines."""
    size = lambda t: f"""(case when length({t}) <= {cap} then length({t})
      when length(regexp_extract(substr({t}, 1, {cap + 5}), '(?s)^(.*{_MARK})', 1)) > 0
      then length(regexp_extract(substr({t}, 1, {cap + 5}), '(?s)^(.*{_MARK})', 1)) else {cap} end)"""
    return f""",
m as (select *, length(text) // 2 as mid, list_filter(range(length(text)), lambda i: regexp_matches(substr(text, i + 1, 1), '{_MARK}')) as marks from {rows}),
cuts as (select *, list_reduce(marks, lambda best, p: case when abs(p - mid) < abs(best - mid) then p + 1 else best end, mid) as cut,
  substr(text, 1, {size('text')}) as l1, substr(text, {size('text')} + 1) as rest from m)
select {kept}, case when length(text) <= {cap} then text
  when length(text) <= {2 * cap} then substr(text, 1, cut) || {mark} || substr(text, cut + 1)
  when rest = '' then l1 else l1 || {mark} || substr(rest, 1, {size('rest')}) end as lines from cuts"""


@query("two_line_layout", O.with_(O.SEGMENTS) + laid_out(42, "segments", "transcript_id, seg_idx", "'|'"))
def two_line_layout(spark, sf):
    return X.segments(spark, sf).select("transcript_id", "seg_idx", F.array_join(txt.two_lines(F.col("text"), 42, 2), "|").alias("lines"))


@query("time_codes", O.with_(O.SEGMENTS) + """
select transcript_id, seg_idx,
  printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms % 3600000 // 60000, start_ms % 60000 // 1000, start_ms % 1000) as srt,
  printf('%d:%02d:%02d.%02d', end_ms // 3600000, end_ms % 3600000 // 60000, end_ms % 60000 // 1000, end_ms % 1000 // 10) as ass,
  start_ms as srt_ms, end_ms // 10 * 10 as ass_ms from segments""")
def time_codes(spark, sf):
    rows = X.segments(spark, sf).select(
        "transcript_id", "seg_idx", timecode.srt_time(F.col("start_ms")).alias("srt"), timecode.ass_time(F.col("end_ms")).alias("ass")
    )
    return rows.withColumns({"srt_ms": timecode.parse_srt_time(F.col("srt")), "ass_ms": timecode.parse_ass_time(F.col("ass"))})


@query("aspect_ratios", """
with spec as (select page_id, (page_id % 40 + 1) || (case page_id % 4 when 0 then ':' when 1 then 'x' when 2 then '/' else '-' end) || (page_id % 30 + 1) as s from pages)
select page_id, case when s like '%-%' then 16 else cast(regexp_extract(s, '^(\\d+)', 1) as int) end as width,
  case when s like '%-%' then 9 else cast(regexp_extract(s, '(\\d+)$', 1) as int) end as height from spec""")
def aspect_ratios(spark, sf):
    p = F.col("page_id")
    mark = F.get(F.array(*map(F.lit, ":x/-")), (p % 4).cast("int"))
    spec = F.concat((p % 40 + 1).cast("string"), mark, (p % 30 + 1).cast("string"))
    return X.table(spark, sf, "pages").select("page_id", timecode.aspect_ratio(spec).alias("r")).select("page_id", "r.*")


# -- rule joins -----------------------------------------------------------------------


@query("keyword_scan", """
with words(keyword) as (values ('letre'), ('schein'), ('there'), ('paris'), ('ción'))
select doc_id, keyword from documents join words on contains(text, keyword)""")
def keyword_scan(spark, sf):
    return rules.keyword_scan(documents(spark, sf), ["letre", "schein", "there", "paris", "ción"]).select("doc_id", "keyword")


@query("character_scan", """
select doc_id, array_to_string(regexp_extract_all(text, '[êçßñ]')[1:5], '') as first_found, len(regexp_extract_all(text, '[êçßñ]')) as n
from documents where regexp_matches(text, '[êçßñ]')""")
def character_scan(spark, sf):
    rows = rules.character_scan(documents(spark, sf), "êçßñ")
    return rows.select("doc_id", F.array_join(F.slice("found", 1, 5), "").alias("first_found"), F.size("found").cast("long").alias("n"))


@query("errata_violations", O.with_(O.RULES) + """
select doc_id, 'errata_violation' as issue_type, 'critical' as severity, wrong || '→' || correct as detail
from documents join rules on wrong <> correct and contains(text, wrong)""")
def errata_violations(spark, sf):
    hits = rules.literal_hits(F.col("text"), latin_rules(spark).literal)
    return documents(spark, sf).select("doc_id", F.inline(hits)).drop("value")


@query("errata_violations_by_join", O.with_(O.SEGMENTS) + """,
words as (select distinct unnest(regexp_extract_all(text, '[a-z]{5,7}')) as wrong from benchmark)
select transcript_id, seg_idx, wrong, upper(wrong) as correct from segments join words on contains(text, wrong)""")
def errata_violations_by_join(spark, sf):
    words = X.table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,7}"), F.lit(0))).alias("wrong")
    ).distinct()
    table = words.select("wrong", F.upper("wrong").alias("correct"))
    hits = rules.rule_hits_by_join(X.segments(spark, sf).select("transcript_id", "seg_idx", "text"), table, lengths=[5, 6, 7])
    return hits.select("transcript_id", "seg_idx", "wrong", "correct")


_REGEX = O.values("patterns", "pattern, replacement", X.REGEX_RULES)
_SEMANTIC = O.values("semantic", "pattern, correction, description", X.SEMANTIC_RULES)


@query("asr_detection", O.with_(O.RULES, _REGEX) + """
select doc_id, 'asr_phonetic_error' as issue_type, wrong || '→' || correct as detail from documents join rules on contains(text, wrong)
union all
select doc_id, 'asr_phonetic_error', regexp_extract(text, pattern) || '→' || replacement from documents join patterns on regexp_matches(text, pattern)""")
def asr_detection(spark, sf):
    body = F.col("body")
    found = F.concat(rules.literal_hits(body, latin_rules(spark).literal, "asr_phonetic_error"), rules.regex_hits(body, X.REGEX_RULES))
    return stripped(spark, sf).select("doc_id", F.inline(found)).select("doc_id", "issue_type", "detail")


_SUSPICIOUS = O.values("suspicious", "pattern, hint", X.SUSPICIOUS)


@query("semantic_anomalies", O.with_(_SEMANTIC, _SUSPICIOUS) + """
select doc_id, 'semantic_anomaly' as issue_type, 'critical' as severity, pattern || '→' || correction as detail
from documents join semantic on correction is not null and regexp_matches(text, pattern)
union all
select doc_id, 'suspicious_pattern', 'info', hint from documents join suspicious on regexp_matches(text, pattern)""")
def semantic_anomalies(spark, sf):
    found = F.concat(rules.semantic_hits(F.col("body"), X.SEMANTIC_RULES), rules.suspicious_hits(F.col("text"), X.SUSPICIOUS))
    return stripped(spark, sf).select("doc_id", F.inline(found)).drop("value")


CONTEXT = """
ctx as (
  select *, array_to_string(list(text) over (
    partition by transcript_id order by seg_idx rows between 3 preceding and 3 following), ' ') as context from segments)"""


def _any(words) -> str:
    return "(" + " or ".join(f"contains(context, {O.quote(w)})" for w in words) + ")"


CONTEXTUAL = "\nunion all\n".join(
    [
        f"""select transcript_id, seg_idx as entry_index, 'contextual_{domain}_errata' as issue_type, 'critical' as severity,
  null::double as value, wrong || '→' || correct as detail
from ctx join rules on contains(text, wrong) and not contains(text, correct) where {_any(words)}"""
        for domain, words in X.KEYWORDS
    ]
    + [
        f"""select transcript_id, seg_idx, 'contextual_disambiguation', 'critical', null, {O.quote(w + '→' + c)}
from ctx where contains(text, {O.quote(w)}) and {_any(cues)}"""
        for cues, fixes in X.DISAMBIGUATION
        for w, c in fixes
    ]
)


@query("contextual_errata", O.with_(O.SEGMENTS, CONTEXT, O.RULES) + CONTEXTUAL)
def contextual_errata(spark, sf):
    rows = timeline.with_context(X.segments(spark, sf), KEY)
    rows = rows.withColumn("body", txt.strip(F.col("text")))
    found = rules.contextual_hits(F.col("body"), F.col("context"), latin_rules(spark))
    return rows.select("transcript_id", F.col("seg_idx").alias("entry_index"), F.inline(found))


TOKEN_PATTERN = "|".join(sorted(X.DICTIONARY, key=lambda w: (-len(w), w)))


@query("word_tokens", f"""
with t as (select doc_id, unnest(regexp_extract_all(text, '(?s){TOKEN_PATTERN}|.')) as token from documents)
select token, count(*) as n from t where length(token) > 1 group by token""")
def word_tokens(spark, sf):
    words = documents(spark, sf).select(F.explode(rules.tokens(F.col("text"), X.DICTIONARY)).alias("token"))
    return words.where(F.length("token") > 1).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
