"""The flagship query: from segments and clips to a timing score per clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import text as txt
from cueline.operators import checks, scoring, timeline
from cueline.params import LATIN
from cueline.plans import fixtures as X
from cueline.plans import oracle as O
from cueline.plans.queries_text import _CLEAN, _fitted
from cueline.plans.registry import query

KEYS = ["transcript_id", "clip_id"]

_N = O.letters("text")
_RATE = f"{_N} / ((end_ms - start_ms) / 1000.0)"


@query("clip_audit", O.with_(O.SEGMENTS, O.CLIPS) + f""",
cut as (
  select s.transcript_id, c.clip_id, s.seg_idx, {_CLEAN.format("replace(s.text, chr(10), '')")} as t,
    greatest(s.start_ms, c.start_ms) - c.start_ms as start_ms, least(s.end_ms, c.end_ms) - c.start_ms as end_ms
  from segments s join clips c on s.transcript_id = c.transcript_id and s.start_ms < c.end_ms and s.end_ms > c.start_ms),
shown as (select transcript_id, clip_id, start_ms, end_ms, {_fitted('t', '42')} as text,
  lead(start_ms) over (partition by transcript_id, clip_id order by start_ms, seg_idx) as after_ms from cut where end_ms - start_ms >= 500),
counted as (select transcript_id, clip_id,
  (case when {_N} > 0 and {_RATE} > 36 then 1 else 0 end) + (case when end_ms > after_ms then 1 else 0 end) as c,
  (case when end_ms - start_ms < 1000 or end_ms - start_ms > 7000 then 1 else 0 end) + (case when {_N} > 0 and {_RATE} > 27 and {_RATE} <= 36 then 1 else 0 end) as w
  from shown)
select transcript_id, clip_id, count(*) as total_entries, cast(sum(c) as bigint) as critical_count, cast(sum(w) as bigint) as warning_count,
  greatest(0.0::double, cast(100 - 15 * sum(c) - 2 * sum(w) as double)) as score, sum(c) = 0 as passed
from counted group by transcript_id, clip_id""")
def clip_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = timeline.extract_clip_entries(X.segments(spark, sf_dir), X.clips(spark, sf_dir))
    placed = timeline.number_in_clip(cut, KEYS, order=("pos",))
    ahead = timeline.with_next(placed, KEYS, "clip_pos").withColumn("text", txt.fit_line(F.col("text"), 42, LATIN.clause_marks))
    ahead = checks.measured(ahead, LATIN)
    found = checks.family(checks.display_duration(LATIN), checks.reading_speed(LATIN), checks.overlap_with_next())
    return scoring.timing_score(ahead, KEYS, found)
