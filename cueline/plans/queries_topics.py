"""Queries over topics, keywords, clip and version planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.operators import topics
from cueline.params import TopicParams
from cueline.plans import fixtures as X
from cueline.plans import oracle as O
from cueline.plans.registry import query
from cueline.sources import writers

KEY = ["transcript_id"]
STOP = ("the", "and", "der", "die", "de", "que", "en", "la", "le", "un")
PARAMS = TopicParams(min_topic_s=20.0, max_topic_s=60.0, silence_s=1.0, word_pattern="[A-Za-z]{2,6}", stop_words=STOP)

SILENT = """
silent as (
  select s.*, s.prev_end_ms in (select prev_end_ms from sorted x where x.transcript_id = s.transcript_id and x.gap_ms >= 1000) as after_silence
  from sorted s)"""
CUTS = """
cuts as (
  select transcript_id, pos, cast(1 as bigint) as topic_no, pos as topic_start, end_ms - start_ms as have from silent where pos = 0
  union all
  select n.transcript_id, n.pos, case when c.have >= 20000 and (c.have >= 60000 or n.after_silence) then c.topic_no + 1 else c.topic_no end,
    case when c.have >= 20000 and (c.have >= 60000 or n.after_silence) then n.pos else c.topic_start end,
    case when c.have >= 20000 and (c.have >= 60000 or n.after_silence) then 0 else c.have end + n.end_ms - n.start_ms
  from cuts c join silent n on n.transcript_id = c.transcript_id and n.pos = c.pos + 1),
topic_rows as (select s.*, c.topic_no, c.topic_start from segments s join cuts c on c.transcript_id = s.transcript_id and c.pos = s.pos)"""
BASE = (O.SEGMENTS, O.SORTED, SILENT, CUTS)
_STOP = ", ".join(O.quote(w) for w in STOP)
WORDS = f"""
words as (select *, unnest(range(1, len(found) + 1)) as at_no from (
  select transcript_id, topic_no, pos, regexp_extract_all(text, '[A-Za-z]{{2,6}}') as found from topic_rows)),
counted as (select transcript_id, topic_no, found[at_no] as word, count(*) as n, min(pos * 100000 + at_no) as first_at from words
  where found[at_no] not in ({_STOP}) group by all),
ranked as (select *, row_number() over (partition by transcript_id, topic_no order by n desc, first_at) as rank from counted)"""
TOPICS = """
topics as (
  select transcript_id, topic_no, printf('topic_%03d', topic_no) as topic_id,
    case when len(ws) > 0 then ws[1] when first_text <> '' then (case when length(first_text) > 20 then substr(first_text, 1, 20) || '...' else first_text end)
      else '未命名主题' end as title,
    start_ms, end_ms, n_segments, array_to_string(ws[1:5], ',') as keywords,
    case when length(whole) > 200 then substr(whole, 1, 200) || '...' else whole end as summary,
    case when len(ws) > 0 then least(1.0::double, 0.7::double + least(1.0::double, n_segments / 10) * 0.3::double) else 0.0::double end as coherence,
    first_line, last_line, ws[1:5] as kw
  from (select transcript_id, topic_no, min(start_ms) as start_ms, arg_max(end_ms, pos) as end_ms, count(*) as n_segments,
      arg_min(text, pos) as first_text, substr(arg_min(text, pos), 1, 50) as first_line, substr(arg_max(text, pos), 1, 50) as last_line,
      string_agg(text, ' ' order by pos) as whole from topic_rows group by all)
  left join (select transcript_id, topic_no, list(word order by rank) as ws from ranked where rank <= 10 group by all) using (transcript_id, topic_no))"""
VERSIONS = """
seated as (
  select *, row_number() over (partition by transcript_id order by first_no, topic_no) - 1 as place, count(*) over (partition by transcript_id) as total
  from (select t.*, min(topic_no) over (partition by transcript_id, coalesce(kw[1], '其他')) as first_no from topics t)),
versioned as (
  select *, case when total > 3 and total % 3 > 0 and total % 3 < 2 and place // 3 + 1 > total // 3 then total // 3 else place // 3 + 1 end as version_no from seated)"""
PACK = TopicParams(min_topic_s=20.0, max_topic_s=60.0, silence_s=1.0, word_pattern="[A-Za-z]{2,6}", stop_words=STOP, max_clips=3, min_clips=2)


def topic_rows(spark, sf):
    return X._once(spark, sf, "topic-rows", lambda: topics.segment_topics(X.segments(spark, sf), KEY, PARAMS))


def assembled(spark, sf):
    return X._once(spark, sf, "topics", lambda: topics.assemble_topics(topic_rows(spark, sf), KEY, PARAMS))


@query("split_points", O.with_(O.SEGMENTS, O.SORTED, SILENT) + "select transcript_id, pos, coalesce(after_silence, false) as after_silence from silent")
def split_points(spark, sf):
    return topics.after_silence(X.segments(spark, sf), KEY, PARAMS).select("transcript_id", "pos", "after_silence")


@query("topic_segments", O.recursive(*BASE) + "select transcript_id, pos, topic_no, topic_start from topic_rows")
def topic_segments(spark, sf):
    return topics.segment_topics(X.segments(spark, sf), KEY, PARAMS).select("transcript_id", "pos", "topic_no", "topic_start")


@query("topic_keywords", O.recursive(*BASE, WORDS) + "select transcript_id, topic_no, rank, word, n from ranked where rank <= 10")
def topic_keywords(spark, sf):
    return topics.top_keywords(topic_rows(spark, sf), ["transcript_id", "topic_no"], 10, PARAMS)


@query("corpus_keywords", f"""
with w as (select lang, doc_id, found, unnest(range(1, len(found) + 1)) as at_no from (
  select lang, doc_id, regexp_extract_all(text, '[A-Za-z]{{2,6}}') as found from documents)),
c as (select lang, found[at_no] as word, count(*) as n, min(doc_id * 10000000 + at_no) as first_at from w where found[at_no] not in ({_STOP}) group by all)
select lang, row_number() over (partition by lang order by n desc, first_at) as rank, word, n from c
qualify row_number() over (partition by lang order by n desc, first_at) <= 10""")
def corpus_keywords(spark, sf):
    return topics.top_keywords(X.table(spark, sf, "documents"), ["lang"], 10, PARAMS, pos="doc_id")


@query("topics", O.recursive(*BASE, WORDS, TOPICS) + "select * exclude (kw) replace (coalesce(keywords, '') as keywords) from topics")
def topics_query(spark, sf):
    rows = topics.assemble_topics(topic_rows(spark, sf), KEY, PARAMS)
    return rows.withColumn("keywords", F.array_join("keywords", ","))


@query("topic_coherence", O.recursive(*BASE, WORDS, TOPICS) + """
select transcript_id, topic_no, case when k > 0 then least(1.0::double, hits / k * 0.7::double + least(1.0::double, n_segments / 10) * 0.3::double) else 0.0::double end as coherence
from (select t.transcript_id, t.topic_no, t.n_segments, coalesce(len(g.kw), 0) as k,
    len(list_filter(coalesce(g.kw, []), lambda w: contains(x.whole, w))) as hits
  from topics t left join topics g on g.transcript_id = t.transcript_id and g.topic_no = t.topic_no + 1
  join (select transcript_id, topic_no, string_agg(text, chr(10) order by pos) as whole from topic_rows group by all) x
    on x.transcript_id = t.transcript_id and x.topic_no = t.topic_no)""")
def topic_coherence(spark, sf):
    """How well the keywords of the following topic fit a topic."""
    given = assembled(spark, sf).select(
        "transcript_id", (F.col("topic_no") - 1).alias("topic_no"), F.explode("keywords").alias("word")
    )
    return topics.coherence(topic_rows(spark, sf), given, ["transcript_id", "topic_no"])


@query("topic_clips", O.recursive(*BASE, WORDS, TOPICS) + """
select transcript_id, 'clip_' || topic_id as clip_id, title, start_ms, end_ms, first_line, last_line, topic_id, coalesce(keywords, '') as keywords,
  substr(summary, 1, 100) as description from topics where end_ms > start_ms""")
def topic_clips(spark, sf):
    rows = topics.clips_from_topics(assembled(spark, sf)).withColumn("keywords", F.array_join("keywords", ","))
    return rows.select("transcript_id", "clip_id", "title", "start_ms", "end_ms", "first_line", "last_line", "topic_id", "keywords", "description")


@query("clip_materials", O.recursive(*BASE, WORDS, TOPICS) + """,
c as (select *, 'clip_' || topic_id as clip_id, least(30000.0::double, (end_ms - start_ms) / 1000 * 0.1::double * 1000) as od,
  least(20000.0::double, (end_ms - start_ms) / 1000 * 0.08::double * 1000) as ed from topics where end_ms > start_ms)
select transcript_id, clip_id as source_clip_id, 'opening_' || clip_id as material_id, 'opening' as material_type, 'golden_quote' as category,
  start_ms, start_ms + cast(trunc(od) as bigint) as end_ms, '开场_' || title as label from c where od > 5000
union all
select transcript_id, clip_id, 'ending_' || clip_id, 'ending', 'summary', end_ms - cast(trunc(ed) as bigint), end_ms, '结尾_' || title from c where ed > 3000""")
def clip_materials(spark, sf):
    return topics.materials(topics.clips_from_topics(assembled(spark, sf)), KEY, PARAMS)


@query("version_assignment", O.recursive(*BASE, WORDS, TOPICS, VERSIONS) + "select transcript_id, topic_id, place, version_no from versioned")
def version_assignment(spark, sf):
    rows = topics.assign_versions(assembled(spark, sf), KEY, PACK)
    return rows.select("transcript_id", "topic_id", F.col("_place").alias("place"), "version_no")


@query("version_plans", O.recursive(*BASE, WORDS, TOPICS, VERSIONS) + """,
kws as (select transcript_id, version_no, w, min(place * 10 + i) as at_no from (
  select transcript_id, version_no, place, unnest(kw[1:2]) as w, unnest(range(len(kw[1:2]))) as i from versioned) group by all),
themes as (select transcript_id, version_no, array_to_string((list(w order by at_no))[1:3], '、') as theme from kws group by all)
select transcript_id, version_no, 'v' || version_no || '_' || coalesce(theme, '版本' || version_no) as version_key, coalesce(theme, '版本' || version_no) as theme,
  count(*) filter (end_ms > start_ms) as n_clips, cast(sum(case when end_ms > start_ms then end_ms - start_ms else 0 end) as bigint) / 1000 as estimated_duration_s
from versioned left join themes using (transcript_id, version_no) group by all""")
def version_plans(spark, sf):
    return topics.plan_versions(topics.assign_versions(assembled(spark, sf), KEY, PACK), KEY, PACK)


@query("topic_listing", O.recursive(*BASE, WORDS, TOPICS) + """
select transcript_id, topic_id, topic_id || ': ' || title || printf(' (%.0fs-%.0fs, %.1fmin)', round_even(start_ms / 1000, 0), round_even(end_ms / 1000, 0), round_even((end_ms - start_ms) / 60000, 1)) as value from topics""")
def topic_listing(spark, sf):
    return assembled(spark, sf).select("transcript_id", "topic_id", writers.topic_listing().alias("value"))
