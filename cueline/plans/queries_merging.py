"""Queries over the sequential merges; the oracles step row by row in recursive SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cueline.operators import merging, rules
from cueline.params import LATIN
from cueline.plans import fixtures as X
from cueline.plans import jobs
from cueline.plans import oracle as O
from cueline.plans.queries_text import laid_out
from cueline.plans.registry import query

KEY = ["transcript_id"]
T = O.strip("n.text")
N_CUR, N_BOTH = O.letters("m.text"), O.letters(f"m.text || {T}")
SPAN = "(n.end_ms - m.start_ms)"
_FITS = f"""n.start_ms - m.end_ms <= 2000 and {N_BOTH} <= 42 and {SPAN} <= 7000
    and (case when {SPAN} > 0 then {N_BOTH} / ({SPAN} / 1000.0) else 0 end) <= 27"""
_DONE = f"""regexp_matches({O.strip('m.text')}, '[。！？.!?]$') and m.end_ms - m.start_ms >= 1000 and {N_CUR} >= 4
    and {N_CUR} / ((m.end_ms - m.start_ms) / 1000.0) <= 27"""
_JOIN = f"(({_FITS}) and not ({_DONE}))"
GREEDY = f"""
m as (
  select transcript_id, pos, pos as first_pos, start_ms, end_ms, {O.strip('text')} as text from segments where pos = 0
  union all
  select n.transcript_id, n.pos, case when {_JOIN} then m.first_pos else n.pos end, case when {_JOIN} then m.start_ms else n.start_ms end,
    n.end_ms, case when {_JOIN} then m.text || {T} else {T} end
  from m join segments n on n.transcript_id = m.transcript_id and n.pos = m.pos + 1)"""
GREEDY_OUT = """
select transcript_id, first_pos, max(pos) as last_pos, arg_max(start_ms, pos) as start_ms, arg_max(end_ms, pos) as end_ms, trim(arg_max(text, pos)) as text
from m group by transcript_id, first_pos"""


def _spans(df):
    return df.select(
        "transcript_id", F.array_min("source_rows").alias("first_pos"), F.array_max("source_rows").alias("last_pos"),
        "start_ms", "end_ms", "text",
    )


@query("merged_short_segments", O.recursive(O.OPEN_SEGMENTS, GREEDY) + GREEDY_OUT)
def merged_short_segments(spark, sf):
    return _spans(merging.merge_short_segments(X.open_segments(spark, sf), KEY, LATIN))


@query("merged_closed_segments", O.recursive(O.SEGMENTS, GREEDY) + GREEDY_OUT)
def merged_closed_segments(spark, sf):
    return _spans(merging.merge_short_segments(X.segments(spark, sf), KEY, LATIN))


_SPLIT = f"""
long as (select *, (end_ms - start_ms) / greatest(1, length(text)) as per_char,
    case when regexp_matches(text, '[.!?;,]') then list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substr(text, i, 1), '[.!?;,]'))
      else [length(text) // 2] end as cuts
  from segments where {O.letters('text')} > 42 or end_ms - start_ms > 7000),
walk as (
  select transcript_id, pos, 0 as k, cast(0 as bigint) as begin_at, cast(null as bigint) as from_at, cast(null as bigint) as to_at from long
  union all
  select w.transcript_id, w.pos, w.k + 1,
    case when {O.letters('substr(l.text, w.begin_at + 1, l.cuts[w.k + 1] - w.begin_at)')} >= 4 then l.cuts[w.k + 1] else w.begin_at end,
    case when {O.letters('substr(l.text, w.begin_at + 1, l.cuts[w.k + 1] - w.begin_at)')} >= 4 then w.begin_at end,
    case when {O.letters('substr(l.text, w.begin_at + 1, l.cuts[w.k + 1] - w.begin_at)')} >= 4 then l.cuts[w.k + 1] end
  from walk w join long l on l.transcript_id = w.transcript_id and l.pos = w.pos where w.k < len(l.cuts)),
tails as (select w.transcript_id, w.pos, max(begin_at) as begin_at, max(to_at) as last_to from walk w group by all),
parts as (
  select l.transcript_id, l.pos, w.from_at, w.to_at, l.start_ms + cast(trunc(w.from_at * per_char) as bigint) as start_ms,
    case when w.to_at = t.last_to and {O.strip('substr(l.text, t.begin_at + 1)')} <> '' and {O.letters('substr(l.text, t.begin_at + 1)')} < 2 then l.end_ms
      else l.start_ms + cast(trunc(w.to_at * per_char) as bigint) end as end_ms,
    {O.strip('substr(l.text, w.from_at + 1, w.to_at - w.from_at)')}
      || case when w.to_at = t.last_to and {O.letters('substr(l.text, t.begin_at + 1)')} < 2 then {O.strip('substr(l.text, t.begin_at + 1)')} else '' end as text
  from walk w join long l using (transcript_id, pos) join tails t using (transcript_id, pos) where w.to_at is not null
  union all
  select l.transcript_id, l.pos, t.begin_at, length(l.text), l.start_ms + cast(trunc(t.begin_at * per_char) as bigint), l.end_ms, {O.strip('substr(l.text, t.begin_at + 1)')}
  from long l join tails t using (transcript_id, pos) where {O.letters('substr(l.text, t.begin_at + 1)')} >= 2
  union all
  select l.transcript_id, l.pos, 0, 0, l.start_ms, l.end_ms, l.text from long l join tails t using (transcript_id, pos)
  where t.last_to is null and {O.letters('substr(l.text, t.begin_at + 1)')} < 2
  union all
  select s.transcript_id, s.pos, 0, 0, s.start_ms, s.end_ms, s.text from segments s
  where not ({O.letters('text')} > 42 or end_ms - start_ms > 7000))"""


@query("split_segments", O.recursive(O.SEGMENTS, _SPLIT) + "select transcript_id, pos as source_pos, start_ms, end_ms, text from parts")
def split_segments(spark, sf):
    rows = merging.split_long_segments(X.segments(spark, sf), KEY, LATIN)
    return rows.select("transcript_id", F.element_at("source_rows", 1).alias("source_pos"), "start_ms", "end_ms", "text")


# The pairing steps as a machine over rows: l_* is the latest result, w_* the row that
# waits for its successor; each step may close one or two results.
def _letters_of(a, b):
    return O.letters(f"{a} || {b}")


def _pair(a: str, b: str) -> str:
    chars, span = _letters_of(f"{a}.text", f"{b}.text"), f"({b}.end_ms - {a}.start_ms)"
    return f"coalesce({chars} <= 42 and {span} <= 7000 and (case when {span} > 0 then {chars} / ({span} / 1000.0) else 0 end) <= 27, false)"


def _machine(care: str, back_first: str, settle: str, source: str = "segments") -> str:
    """Recursive machine over ``source``. ``care``, ``back_first`` are conditions on row ``n``;
    ``settle`` is the list of results after the waiting row ``w`` could not join
    forward, given ``l`` (a list so that a closed result can be passed on)."""
    seg = "struct_pack(start_ms := n.start_ms, end_ms := n.end_ms, text := n.text, first_pos := n.pos)"
    join = lambda a, b: f"struct_pack(start_ms := {a}.start_ms, end_ms := {b}.end_ms, text := {a}.text || {b}.text, first_pos := {a}.first_pos)"
    return f"""
rows0 as (select transcript_id, pos, n_rows, {seg.replace('n.', '')} as seg from {source}),
steps as (
  select transcript_id, cast(-1 as bigint) as pos, max(n_rows) as n_rows, cast(null as struct(start_ms bigint, end_ms bigint, text varchar, first_pos bigint)) as l,
    cast(null as struct(start_ms bigint, end_ms bigint, text varchar, first_pos bigint)) as w,
    cast([] as struct(start_ms bigint, end_ms bigint, text varchar, first_pos bigint)[]) as closed
  from {source} group by transcript_id
  union all
  select transcript_id, pos, n_rows,
    case when ate then fwd when joined_back then {join('l2', 'n')} when waits then l2 else n end as l,
    case when not ate and waits then n end as w,
    case when ate then (case when l is null then [] else [l] end)
      else (case when w is null then [] else settled[1:len(settled) - 1] end) || (case when joined_back or waits or l2 is null then [] else [l2] end) end as closed
  from (
    select *, not ate and ({care}) and ({back_first}) and {_pair('l2', 'n')} as joined_back,
      not ate and ({care}) and not (({back_first}) and {_pair('l2', 'n')}) as waits
    from (
      select *, case when w is null then l else settled[len(settled)] end as l2 from (
        select s.transcript_id, r.pos, s.n_rows, s.l, s.w, r.seg as n, s.w is not null and {_pair('s.w', 'r.seg')} as ate,
          {join('s.w', 'r.seg')} as fwd, {settle} as settled
        from steps s join rows0 r on r.transcript_id = s.transcript_id and r.pos = s.pos + 1))))"""


def _results(last: str) -> str:
    """Closed results plus what the end of the transcript settles; ``last`` is a list."""
    return f"""
final as (select transcript_id, {last} as closed from steps s where pos = n_rows - 1),
results as (select transcript_id, unnest(closed) as r from (select transcript_id, closed from steps union all select transcript_id, closed from final))
select transcript_id, r.first_pos as first_pos, r.start_ms as start_ms, r.end_ms as end_ms, r.text as text from results"""


def _list(*items: str) -> str:
    return "[" + ", ".join(items) + "]"


_JOINED = "struct_pack(start_ms := s.l.start_ms, end_ms := s.w.end_ms, text := s.l.text || s.w.text, first_pos := s.l.first_pos)"
_KEEP = "(case when s.l is null then [s.w] else [s.l, s.w] end)"
_BACK = f"(case when s.l is not null and {_pair('s.l', 's.w')} then [{_JOINED}] else {_KEEP} end)"


def _extended(end: str) -> str:
    w = f"struct_pack(start_ms := s.w.start_ms, end_ms := cast({end} as bigint), text := s.w.text, first_pos := s.w.first_pos)"
    return f"(case when s.l is null then [{w}] else [s.l, {w}] end)"


_ROOM = "(r.seg.start_ms - s.w.end_ms)"
_GROW = f"""s.w.end_ms + least(case when {_ROOM} > 134 then {_ROOM} - 67 when {_ROOM} > 0 then {_ROOM} // 2 else 0 end, 1000 - (s.w.end_ms - s.w.start_ms))"""
SHORT = "n.end_ms - n.start_ms < 1000"
FAST = f"(case when n.end_ms > n.start_ms then {O.letters('n.text')} / ((n.end_ms - n.start_ms) / 1000.0) else 0 end) > 27"
_NT = O.strip("n.text")
TINY = f"""({O.letters(_NT)} <= 3 or n.end_ms - n.start_ms < 1000 or ({O.letters(_NT)} <= 5 and regexp_matches({_NT}, '^[eaoE]')))"""


def _after(settle_end: str) -> str:
    return _results(f"case when s.w is null then [s.l] else {settle_end} end")


@query("lengthened_segments", O.recursive(O.OPEN_SEGMENTS, _machine(SHORT, "true", _extended(_GROW))) + "," + _after(_extended("s.w.start_ms + 1000")))
def lengthened_segments(spark, sf):
    return _spans(merging.ensure_minimum_duration(X.open_segments(spark, sf), KEY, LATIN)).drop("last_pos")


@query("merged_fast_segments", O.recursive(O.OPEN_SEGMENTS, _machine(FAST.replace("27", "22.5"), "false", _BACK).replace("<= 27", "<= 22.5")) + "," + _after(_KEEP).replace("<= 27", "<= 22.5"))
def merged_fast_segments(spark, sf):
    return _spans(merging.merge_fast_segments(X.open_segments(spark, sf), KEY, LATIN.with_values(reading_speed=15.0))).drop("last_pos")


@query("merged_fragments", O.recursive(O.OPEN_SEGMENTS, _machine(TINY, "regexp_matches(n.text, '[ehn]$')", _BACK)) + "," + _after(_BACK))
def merged_fragments(spark, sf):
    return _spans(merging.merge_tiny_fragments(X.open_segments(spark, sf), KEY, LATIN)).drop("last_pos")


def _stage(name: str, sql: str) -> str:
    """A chain stage whose inner tables get the stage's name as a suffix."""
    for inner in ("rows0", "steps", "final", "results"):
        sql = re.sub(rf"\b{inner}\b", f"{inner}_{name}", sql)
    return sql


def _ordered(name: str, select: str, order: str) -> str:
    """Results of a stage, numbered for the next one."""
    return f"""
{name} as (select *, row_number() over (partition by transcript_id order by {order}) - 1 as pos,
  count(*) over (partition by transcript_id) as n_rows from ({select}))"""


def _piece(name: str, source: str, care: str, back_first: str, settle: str, last: str, order: str) -> str:
    tail = _results(f"case when s.w is null then [s.l] else {last} end")
    tables, select = tail.rsplit("\nselect", 1)
    body = _machine(care, back_first, settle, source) + "," + tables
    return _stage(name, body + "," + _ordered(name, "select" + select, order))


CHAIN = ",".join([
    O.OPEN_SEGMENTS, GREEDY,
    """
joined as (select *, first_pos as src from (""" + GREEDY_OUT + """)),
g1 as (select transcript_id, start_ms, end_ms, text, row_number() over (partition by transcript_id order by src) - 1 as pos,
  count(*) over (partition by transcript_id) as n_rows from joined)""",
    re.sub(r"\bsegments\b", "g1", _SPLIT),
    _ordered("g2", "select transcript_id, pos as src, coalesce(from_at, 0) as part, start_ms, end_ms, text from parts", "src, part"),
    _piece("g3", "g2", SHORT, "true", _extended(_GROW), _extended("s.w.start_ms + 1000"), "start_ms, first_pos"),
    _piece("g4", "g3", FAST, "false", _BACK, _KEEP, "first_pos"),
    _piece("g5", "g4", TINY, "regexp_matches(n.text, '[ehn]$')", _BACK, _BACK, "first_pos"),
    f"""
g6 as (select transcript_id, pos, start_ms, text, lead(start_ms) over w as next_ms,
  end_ms - case when lead(start_ms) over w - end_ms < 67 and end_ms - start_ms - 1000 > 0 then least(33, (end_ms - start_ms - 1000) // 2) else 0 end as end_ms
  from g5 window w as (partition by transcript_id order by pos)),
g7 as (select *, {O.letters('text')} as chars, least(start_ms + greatest(cast(trunc({O.letters('text')} / 27.0::double * 1000) as bigint), 1000), next_ms - 67) as wanted,
  case when end_ms > start_ms then {O.letters('text')} / ((end_ms - start_ms) / 1000.0) else 999 end as rate from g6)""",
])


@query("subtitle_entries", "with recursive " + CHAIN + """
select transcript_id, pos + 1 as index, start_ms, case when chars > 0 and rate > 27 and wanted > end_ms then wanted else end_ms end as end_ms, text from g7""")
def subtitle_entries(spark, sf):
    rows = merging.transcript_to_entries(X.open_segments(spark, sf), KEY, LATIN)
    return rows.select("transcript_id", "index", "start_ms", "end_ms", "text")


_NUMBERED = O.with_(O.SEGMENTS) + f""",
kept as (select *, {O.replaced(O.strip('text'), O.flat_rules())} as t from segments where {O.strip('text')} <> ''),
cleaned as (select *, row_number() over (partition by transcript_id order by seg_idx) as index,
  case when t like '%。' then substr(t, 1, length(t) - 1) else t end as shown from kept),
clamped as (select transcript_id, index, start_ms, shown as text,
  case when end_ms - start_ms < 1000 then start_ms + 1000 when end_ms - start_ms > 7000 then start_ms + 7000 else end_ms end as end_ms from cleaned),
timed_rows as (select transcript_id, index, case when start_ms - lag(end_ms) over w < 67 then lag(end_ms) over w + 67 else start_ms end as start_ms, end_ms, text
  from clamped window w as (partition by transcript_id order by index))""" + laid_out(42, "timed_rows", "transcript_id, index, start_ms, end_ms", "chr(10)").replace("as lines", "as text")


@query("simple_subtitles", _NUMBERED)
def simple_subtitles(spark, sf):
    flat = rules.inline_rules(rules.flatten_rules(X.rule_table(spark)))
    rows = jobs.simple_subtitles(X.segments(spark, sf), KEY, LATIN, flat)
    return rows.select("transcript_id", "index", "start_ms", "end_ms", "text")


@query("merged_clip_entries")
def merged_clip_entries(spark, sf):
    return jobs.clip_job(X.segments(spark, sf), X.clips(spark, sf), LATIN).select(
        "transcript_id", "clip_id", "index", "start_s", "end_s", "text"
    )


@query("parameter_sweep")
def parameter_sweep(spark, sf):
    return jobs.sweep(X.open_segments(spark, sf), KEY, LATIN, jobs.LATIN_SETTINGS)


@query("best_setting")
def best_setting(spark, sf):
    from cueline.operators.experiments import best_setting

    return best_setting(jobs.sweep(X.open_segments(spark, sf), KEY, LATIN, jobs.LATIN_SETTINGS))
