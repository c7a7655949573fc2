"""Queries over segment times, neighbours, clips and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.operators import merging, timeline
from cueline.params import LATIN
from cueline.plans import fixtures as X
from cueline.plans import oracle as O
from cueline.plans.registry import query

KEY = ["transcript_id"]


@query("segment_times", O.with_(O.SEGMENTS) + """
select transcript_id, seg_idx, start_ms / 1000 as start_s, end_ms / 1000 as end_s, end_ms - start_ms as duration_ms,
  (end_ms - start_ms) / 1000 as duration_s, (end_ms - start_ms) / 1000 / 60 as duration_min from segments""")
def segment_times(spark, sf):
    return timeline.with_times(X.segments(spark, sf)).select(
        "transcript_id", "seg_idx", "start_s", "end_s", "duration_ms", "duration_s", "duration_min"
    )


@query("time_order", O.with_(O.SEGMENTS) + "select transcript_id, seg_idx, speaker, text, start_ms, end_ms, pos, n_rows from segments")
def time_order(spark, sf):
    return X.segments(spark, sf).select("transcript_id", "seg_idx", "speaker", "text", "start_ms", "end_ms", "pos", "n_rows")


@query("previous_gap", O.with_(O.SEGMENTS, O.SORTED) + "select transcript_id, seg_idx, prev_end_ms, gap_ms from sorted")
def previous_gap(spark, sf):
    return timeline.with_previous(X.segments(spark, sf), KEY).select("transcript_id", "seg_idx", "prev_end_ms", "gap_ms")


@query("next_context", O.with_(O.SEGMENTS, O.SORTED) + """
select transcript_id, seg_idx, coalesce(next_text, '') as next_text, coalesce(next_start_ms - end_ms, 0) as next_gap_ms,
  next_start_ms is null as is_last from sorted""")
def next_context(spark, sf):
    return timeline.with_next(X.segments(spark, sf), KEY).select("transcript_id", "seg_idx", "next_text", "next_gap_ms", "is_last")


@query("context_window", O.with_(O.SEGMENTS) + """
select transcript_id, seg_idx, array_to_string(list(text) over (
  partition by transcript_id order by seg_idx rows between 3 preceding and 3 following), ' ') as context from segments""")
def context_window(spark, sf):
    return timeline.with_context(X.segments(spark, sf), KEY).select("transcript_id", "seg_idx", "context")


@query("silence_points", O.with_(O.SEGMENTS, O.SORTED) + """
select transcript_id, prev_end_ms as start_ms, start_ms as end_ms, gap_ms as duration_ms, prev_end_ms / 1000 as position_s
from sorted where gap_ms >= 1500""")
def silence_points(spark, sf):
    return timeline.silences(X.segments(spark, sf), KEY)


@query("rows_at_indices", O.with_(O.SEGMENTS) + "select transcript_id, seg_idx, text from segments where seg_idx in (0, 5, 11)")
def rows_at_indices(spark, sf):
    return timeline.rows_at(X.segments(spark, sf), [0, 5, 11]).select("transcript_id", "seg_idx", "text")


@query("supported_files", """
select page_id, path from (select page_id, 'media/' || page_id || (case page_id % 6 when 0 then '.MP4' when 1 then '.wav'
  when 2 then '.txt' when 3 then '.Flac' when 4 then '' else '.m4a' end) as path from pages)
where lower(regexp_extract(path, '(\\.[^./]+)$', 1)) in ('.mp4', '.mov', '.mkv', '.avi', '.wav', '.mp3', '.flac', '.m4a')""")
def supported_files(spark, sf):
    kinds = F.array(*[F.lit(e) for e in (".MP4", ".wav", ".txt", ".Flac", "", ".m4a")])
    paths = X.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("media/"), F.col("page_id").cast("string"), F.get(kinds, (F.col("page_id") % 6).cast("int"))).alias("path")
    )
    return timeline.supported_files(paths, [".mp4", ".mov", ".mkv", ".avi", ".wav", ".mp3", ".flac", ".m4a"])


@query("first_and_last_lines", O.with_(O.SEGMENTS) + """
select transcript_id, min(start_ms) as start_ms, arg_max(end_ms, pos) as end_ms, substr(arg_min(text, pos), 1, 50) as first_line,
  substr(arg_max(text, pos), 1, 50) as last_line from segments group by transcript_id""")
def first_and_last_lines(spark, sf):
    return X.segments(spark, sf).groupBy("transcript_id").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"),
        F.min_by(F.left("text", F.lit(50)), "pos").alias("first_line"), F.max_by(F.left("text", F.lit(50)), "pos").alias("last_line"),
    )


_FRAGMENT = f"""({O.letters(O.strip('text'))} <= 3 or end_ms - start_ms < 1000
  or ({O.letters(O.strip('text'))} <= 5 and regexp_matches({O.strip('text')}, '^[eaoE]')))"""
_PAIR = O.letters("text || next_text")


@query("merge_candidates", O.with_(O.OPEN_SEGMENTS, O.SORTED) + f"""
select transcript_id, seg_idx,
  next_start_ms - end_ms <= 2000 and {_PAIR} <= 42 and next_end_ms - start_ms <= 7000 as should_merge,
  {_PAIR} <= 42 and next_end_ms - start_ms <= 7000
    and (case when next_end_ms - start_ms > 0 then {_PAIR} / ((next_end_ms - start_ms) / 1000.0) else 0 end) <= 27 as pair_fits,
  {_FRAGMENT} as is_fragment, regexp_matches({O.strip('text')}, '[。！？.!?]$') as ends_sentence
from sorted where next_start_ms is not null""")
def merge_candidates(spark, sf):
    return merging.merge_candidates(X.open_segments(spark, sf), KEY, LATIN).select(
        "transcript_id", "seg_idx", "should_merge", "pair_fits", "is_fragment", "ends_sentence"
    )


@query("clip_entries", O.with_(O.SEGMENTS, O.CLIPS) + """
select * from (
  select s.transcript_id, c.clip_id, s.seg_idx, greatest(s.start_ms, c.start_ms) - c.start_ms as start_ms,
    least(s.end_ms, c.end_ms) - c.start_ms as end_ms, s.text,
    (least(s.end_ms, c.end_ms) - greatest(s.start_ms, c.start_ms)) / 1000 as duration_s
  from segments s join clips c on s.transcript_id = c.transcript_id and s.start_ms < c.end_ms and s.end_ms > c.start_ms)
where end_ms - start_ms >= 500""")
def clip_entries(spark, sf):
    rows = timeline.extract_clip_entries(X.segments(spark, sf), X.clips(spark, sf))
    return rows.select("transcript_id", "clip_id", "seg_idx", "start_ms", "end_ms", "text", "duration_s")


CLIP_SLICES = """
cut as (
  select s.transcript_id, c.clip_id, s.seg_idx, s.text,
    greatest(s.start_ms, c.start_ms) - c.start_ms as start_ms, least(s.end_ms, c.end_ms) - c.start_ms as end_ms,
    row_number() over (partition by s.transcript_id, c.clip_id order by s.seg_idx) as index
  from segments s join clips c on s.transcript_id = c.transcript_id
    and ((s.start_ms >= c.start_ms and s.end_ms <= c.end_ms) or (s.start_ms < c.end_ms and s.end_ms > c.start_ms))),
clamped as (
  select transcript_id, clip_id, seg_idx, text, index, start_ms,
    case when end_ms - start_ms < 1000 then start_ms + 1000 when end_ms - start_ms > 7000 then start_ms + 7000 else end_ms end as end_ms
  from cut),
clip_subtitles as (
  select transcript_id, clip_id, seg_idx, text, index, end_ms,
    case when start_ms - lag(end_ms) over w < 67 then lag(end_ms) over w + 67 else start_ms end as start_ms
  from clamped window w as (partition by transcript_id, clip_id order by index))"""


@query("clip_subtitles", O.with_(O.SEGMENTS, O.CLIPS, CLIP_SLICES) + "select transcript_id, clip_id, index, start_ms, end_ms, text from clip_subtitles")
def clip_subtitles(spark, sf):
    rows = timeline.slice_clip_subtitles(X.segments(spark, sf), X.clips(spark, sf), params=LATIN)
    return rows.select("transcript_id", "clip_id", "index", "start_ms", "end_ms", "text")


@query("adjusted_timing", O.with_(O.SEGMENTS) + """,
clamped as (
  select transcript_id, seg_idx, start_ms,
    case when end_ms - start_ms < 1000 then start_ms + 1000 when end_ms - start_ms > 7000 then start_ms + 7000 else end_ms end as end_ms
  from segments)
select transcript_id, seg_idx, case when start_ms - lag(end_ms) over w < 67 then lag(end_ms) over w + 67 else start_ms end as start_ms, end_ms
from clamped window w as (partition by transcript_id order by seg_idx)""")
def adjusted_timing(spark, sf):
    return timeline.adjust_timing(X.segments(spark, sf), KEY, "seg_idx", LATIN).select("transcript_id", "seg_idx", "start_ms", "end_ms")


@query("inserted_gaps", O.with_(O.SEGMENTS, O.SORTED) + """
select transcript_id, seg_idx, start_ms, end_ms - case when next_start_ms - end_ms < 67 and end_ms - start_ms - 1000 > 0
  then least(33, (end_ms - start_ms - 1000) // 2) else 0 end as end_ms from sorted""")
def inserted_gaps(spark, sf):
    return timeline.insert_gaps(X.segments(spark, sf), KEY, "pos", LATIN).select("transcript_id", "seg_idx", "start_ms", "end_ms")


@query("extended_for_readability", O.with_(O.OPEN_SEGMENTS, O.SORTED) + f""",
rated as (
  select *, {O.letters('text')} as chars,
    case when end_ms > start_ms then {O.letters('text')} / ((end_ms - start_ms) / 1000.0) else 999 end as rate from sorted),
wanted as (
  select *, least(start_ms + greatest(cast(trunc(chars / 27.0::double * 1000) as bigint), 1000), next_start_ms - 67) as wanted_ms from rated)
select transcript_id, seg_idx, start_ms,
  case when chars > 0 and rate > 27 and wanted_ms > end_ms then wanted_ms else end_ms end as end_ms from wanted""")
def extended_for_readability(spark, sf):
    rows = timeline.extend_for_readability(X.open_segments(spark, sf), KEY, "pos", LATIN)
    return rows.select("transcript_id", "seg_idx", "start_ms", "end_ms")
