"""Shared pieces of the oracle SQL: the derived inputs as common table expressions."""

from __future__ import annotations

from cueline.plans import fixtures as X


def _segments(split: str, text: str, gap: str) -> str:
    return f"""
raw_lines as (
  select conv_id, turn, role, unnest({split}) as raw, generate_subscripts({split}, 1) as line_no from conversations),
lines as (select conv_id, turn, role, line_no, {text} as line from raw_lines),
numbered as (
  select conv_id, role, line, row_number() over (partition by conv_id order by turn, line_no) - 1 as seg_idx
  from lines where length(line) > 0),
timed as (
  select *, length(line) * (40 + 10 * ((conv_id + seg_idx) % 4)) as dur_ms,
    ((conv_id * 31 + seg_idx * 17) % 11) * {gap} as gap_ms from numbered),
placed as (
  select conv_id as transcript_id, seg_idx, role as speaker, line as text,
    cast(sum(dur_ms + gap_ms) over w - dur_ms - gap_ms as bigint) as start_ms,
    cast(sum(dur_ms + gap_ms) over w - gap_ms as bigint) as end_ms
  from timed window w as (partition by conv_id order by seg_idx)),
segments as (
  select *, row_number() over (partition by transcript_id order by start_ms, seg_idx) - 1 as pos,
    count(*) over (partition by transcript_id) as n_rows from placed)"""


SEGMENTS = _segments("string_split(text, chr(10))", "raw", "250 - 500")
OPEN_SEGMENTS = _segments("regexp_split_to_array(text, '[\\n ]')", "regexp_replace(raw, '[.,]', '', 'g')", "25 - 50")
SORTED = """
sorted as (
  select *, lag(end_ms) over w as prev_end_ms, lag(text) over w as prev_text,
    start_ms - lag(end_ms) over w as gap_ms, lead(start_ms) over w as next_start_ms, lead(text) over w as next_text,
    lead(end_ms) over w as next_end_ms
  from segments window w as (partition by transcript_id order by pos))"""
CLIPS = """
clips as (
  select transcript_id, k as clip_no, 'c' || k as clip_id,
    case when k % 2 = 0 then 'highlights' else 'deep' end as series,
    cast(k * 40000 + 5000 as bigint) as start_ms,
    cast(k * 40000 + 5000 + 15000 + (transcript_id % 4) * 10000 as bigint) as end_ms
  from (select distinct transcript_id from segments), (values (0), (1), (2)) n(k))"""
FRAMES = """
frames as (
  select user_id as file_id, rn - 1 as frame_idx, (rn - 1) * 100 as t_ms,
    cast((event_id * 37) % 61 as double) - 60.0 as rms_db
  from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as rn from events))"""
LOUDNESS = """
loudness as (
  select user_id as file_id, cast(count(*) as double) / 10.0 as duration_s,
    -14.0 + cast((user_id * 13) % 9 as double) - 4.0 as lufs,
    -3.0 + cast((user_id * 7) % 5 as double) * 0.75 as true_peak,
    4.0 + cast((user_id * 5) % 10 as double) as lra
  from events group by user_id)"""
EXPERIMENTS = """
experiments as (
  select *, row_number() over (partition by series_id order by ts, experiment_id) - 1 as pos from (
    select o_custkey % 20 as series_id, o_orderkey as experiment_id, o_orderdate as ts,
      cast(o_orderkey % 41 as double) + 60.0 as overall_score, o_orderkey % 7 as critical_count,
      o_orderkey % 5 as fragment_count, o_orderkey % 7 = 0 as passed from orders))"""


def with_(*parts: str) -> str:
    return "with " + ",".join(parts) + "\n"


def recursive(*parts: str) -> str:
    return "with recursive " + ",".join(parts) + "\n"


def letters(text: str) -> str:
    return f"length(regexp_replace({text}, '[^A-Za-z]', '', 'g'))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    cell = lambda v: "null" if v is None else quote(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) as (values {body})"


def flat_rules() -> list[tuple[str, str]]:
    """The literal rules flattened by the stated semantics, for building SQL."""
    flat: dict[str, str] = {}
    from cueline.params import RULE_CATEGORIES

    for category in RULE_CATEGORIES:
        for c, wrong, correct in X.LITERAL_RULES:
            if c == category:
                flat[wrong] = correct
    return list(flat.items())


def replaced(text: str, rules) -> str:
    for wrong, correct in rules:
        text = f"replace({text}, {quote(wrong)}, {quote(correct)})"
    return text


RULES = values("rules", "wrong, correct", flat_rules())
