"""Queries over level frames, cut points, platforms and styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.operators import audio, timeline
from cueline.params import AudioParams
from cueline.plans import fixtures as X
from cueline.plans import oracle as O
from cueline.plans.registry import query

KEY = ["file_id"]


def runs(threshold: float) -> str:
    return f"""
runs as (
  select file_id, min(t_ms) as start_ms, max(t_ms) + 100 as end_ms, count(*) as n_frames from (
    select *, frame_idx - row_number() over (partition by file_id order by frame_idx) as run from frames where rms_db < {threshold})
  group by file_id, run)"""


@query("audio_frames", O.with_(O.FRAMES) + "select * from frames")
def audio_frames(spark, sf):
    return X.audio_frames(spark, sf).drop("n_rows")


@query("quiet_runs", O.with_(O.FRAMES, runs(-40)) + "select * from runs")
def quiet_runs(spark, sf):
    return audio.quiet_runs(X.audio_frames(spark, sf), KEY, -40.0)


@query("breaths", O.with_(O.FRAMES, runs(-30)) + """
select file_id, start_ms / 1000 as start_s, end_ms / 1000 as end_s, (end_ms - start_ms) / 1000 as duration_s from runs
where end_ms - start_ms between 150 and 800""")
def breaths(spark, sf):
    return audio.breaths(X.audio_frames(spark, sf), KEY)


EDGE = """
heard as (select *, row_number() over (partition by file_id order by frame_idx) as a, row_number() over (partition by file_id order by frame_idx desc) as z,
  count(*) over (partition by file_id) as n from frames where rms_db > -60)"""


def _edge(rank: str, kind: str) -> str:
    return f"""select file_id, '{kind}' as issue_type, 'warning' as severity, edge_db, case when n > 5 then next_db else all_db end as mean_db
from (select file_id, any_value(n) as n, max(rms_db) filter ({rank} = 1) as edge_db, sum(rms_db) filter ({rank} between 2 and 5) / 4 as next_db,
    sum(rms_db) / count(*) as all_db from heard where {rank} <= 5 group by file_id)
where n > 2 and edge_db > (case when n > 5 then next_db else all_db end) + 15"""


EDGES = _edge("a", "abrupt_start") + "\nunion all\n" + _edge("z", "abrupt_end")


def heard_frames(spark, sf):
    """The lowest level stands for silence without a level."""
    level = F.when(F.col("rms_db") > -60.0, F.col("rms_db")).otherwise(F.lit(float("-inf")))
    return X.audio_frames(spark, sf).withColumn("rms_db", level)


@query("abrupt_edges", O.with_(O.FRAMES, EDGE) + EDGES)
def abrupt_edges(spark, sf):
    return audio.abrupt_edges(heard_frames(spark, sf), KEY)


_TARGETS = """
cuts as (select user_id as file_id, 'e' || event_id as clip_id, cast(event_id % 700 as bigint) * 10 as start_ms,
  cast(event_id % 700 as bigint) * 10 + 1500 as end_ms from events)"""


def cut_targets(spark, sf):
    e = F.col("event_id")
    return X.table(spark, sf, "events").select(
        F.col("user_id").alias("file_id"), F.concat(F.lit("e"), e.cast("string")).alias("clip_id"),
        (e % 700 * 10).alias("start_ms"), (e % 700 * 10 + 1500).alias("end_ms"),
    )


@query("nearest_silence", O.with_(O.FRAMES, runs(-40), _TARGETS) + """,
points as (select file_id, unnest([start_ms, end_ms]) / 1000 as t_s from runs where end_ms - start_ms >= 300),
targets as (select file_id, clip_id, start_ms / 1000 as target_s from cuts),
near as (select t.*, p.t_s from targets t join points p on p.file_id = t.file_id and p.t_s >= greatest(0.0, target_s - 1.0) and p.t_s <= target_s + 1.0),
best as (select file_id, clip_id, target_s, t_s as silence_s from near
  qualify row_number() over (partition by file_id, clip_id, target_s order by abs(t_s - target_s), t_s) = 1)
select file_id, clip_id, target_s, silence_s from targets left join best using (file_id, clip_id, target_s)""")
def nearest_silence(spark, sf):
    points = audio.silence_boundaries(X.audio_frames(spark, sf), KEY)
    targets = cut_targets(spark, sf).select("file_id", "clip_id", (F.col("start_ms") / 1000).alias("target_s"))
    return timeline.snap_to_silence(targets, points, KEY)


@query("optimised_cuts", O.with_(O.FRAMES, runs(-40), _TARGETS) + """,
points as (select file_id, unnest([start_ms, end_ms]) / 1000 as t_s from runs where end_ms - start_ms >= 300),
targets as (select file_id, clip_id, 'start' as side, start_ms / 1000 as target_s from cuts union all select file_id, clip_id, 'end', end_ms / 1000 from cuts),
near as (select t.*, p.t_s from targets t join points p on p.file_id = t.file_id and p.t_s >= greatest(0.0, target_s - 1.0) and p.t_s <= target_s + 1.0),
best as (select file_id, clip_id, side, t_s as silence_s from near
  qualify row_number() over (partition by file_id, clip_id, side order by abs(t_s - target_s), t_s) = 1),
cut as (select file_id, clip_id, side, coalesce(silence_s, case when side = 'start' then greatest(0.0::double, target_s - 0.1::double) else target_s + 0.1::double end) as t
  from targets left join best using (file_id, clip_id, side))
select file_id, clip_id, max(t) filter (side = 'start') as cut_start_s, max(t) filter (side = 'end') as cut_end_s from cut group by all""")
def optimised_cuts(spark, sf):
    params = AudioParams()
    points = audio.silence_boundaries(X.audio_frames(spark, sf), KEY, params)
    return timeline.optimise_cuts(cut_targets(spark, sf), points, KEY, search_s=params.search_s, padding_s=params.padding_s)


_WANTED = ("bilibili", "douyin", "archive", "xiaoyuzhou", "unknown_site")
_SPECS = O.values("specs", ", ".join(audio.PLATFORM_FIELDS), audio.PLATFORMS)


@query("platform_exports", O.with_(O.LOUDNESS, _SPECS) + f""",
wanted(platform) as (values {', '.join(f"('{w}')" for w in _WANTED)})
select file_id, w.platform, s.platform is not null as success,
  case when s.platform is not null then coalesce(resolution, '1920x1080') end as resolution,
  case when s.platform is not null then coalesce(video_bitrate, '8M') end as video_bitrate,
  case when s.platform is not null then coalesce(fps, 30) end as fps,
  case when s.platform is not null then coalesce(video_codec, 'libx264') end as video_codec,
  case when s.platform is not null then coalesce(pixel_format, 'yuv420p') end as pixel_format,
  case when s.platform is not null then coalesce(audio_codec, 'aac') end as audio_codec,
  case when s.platform is not null then coalesce(audio_bitrate, '192k') end as audio_bitrate,
  case when s.platform is not null then coalesce(sample_rate, 48000) end as sample_rate,
  case when s.platform is not null then coalesce(channels, 2) end as channels
from loudness cross join wanted w left join specs s on s.platform = w.platform""")
def platform_exports(spark, sf):
    rows = audio.platform_fan_out(X.loudness(spark, sf).select("file_id"), _WANTED)
    return rows.select(
        "file_id", "platform", "success", "resolution", "video_bitrate", "fps", "video_codec", "pixel_format",
        "audio_codec", "audio_bitrate", "sample_rate", "channels",
    )


@query("platform_limit_breaks", """
select o_orderkey, o_totalprice / 100 as duration_s, 'douyin' as platform from orders where o_totalprice / 100 > 900""")
def platform_limit_breaks(spark, sf):
    assets = X.table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("duration_s"))
    rows = audio.platform_fan_out(assets, ["bilibili", "douyin", "youtube"])
    return audio.breaks_platform_limits(rows).select("o_orderkey", "duration_s", "platform")


# The platforms' limits, written out for the check.
@query("platform_limits", """
with limits(platform, max_duration_s, max_file_size_gb, max_subtitle_chars) as (
  values ('bilibili', null, 8.0, null), ('douyin', 900.0, null, 12), ('youtube', null, null, null)),
measured as (
  select doc_id, length(text) / 2 as duration_s, octet_length(encode(text)) / 500 as size_gb,
    list_max(list_transform(string_split(text, chr(10)), lambda l: length(l))) as subtitle_chars from documents),
broken as (
  select doc_id, platform, concat_ws(',', case when duration_s > max_duration_s then 'max_duration_s' end,
    case when size_gb > max_file_size_gb then 'max_file_size_gb' end, case when subtitle_chars > max_subtitle_chars then 'max_subtitle_chars' end) as broken
  from measured, limits)
select * from broken where broken <> ''""")
def platform_limits(spark, sf):
    """Documents as subtitle tracks of exports: which limit of which platform they break."""
    lines = F.transform(F.split("text", "\n"), F.length)
    assets = X.table(spark, sf, "documents").select(
        "doc_id", (F.length("text") / 2).alias("duration_s"), (F.octet_length("text") / 500).alias("size_gb"), F.array_max(lines).alias("subtitle_chars")
    )
    rows = audio.platform_fan_out(assets, ["bilibili", "douyin", "youtube"])
    broken = audio.broken_limits(F.col("duration_s"), F.col("size_gb"), F.col("subtitle_chars"))
    return rows.select("doc_id", "platform", F.array_join(broken, ",").alias("broken")).where("broken <> ''")


_STYLES = """
style_frames as (
  select l_orderkey % 300 as video_id, l_orderkey * 10 + l_linenumber as frame_no, ['white', 'black', 'gold', 'red'][l_partkey % 4 + 1] as text_color,
    l_suppkey % 3 = 0 as bg_enabled, cast(20 + l_partkey % 40 as int) as font_size, cast(l_quantity as double) / 64 as confidence from lineitem)"""


@query("merged_styles", O.with_(_STYLES) + """,
top as (select video_id, text_color as bc, font_size as bs from style_frames
  qualify row_number() over (partition by video_id order by confidence desc, frame_no, text_color desc, font_size desc) = 1),
best as (select video_id, count(*) filter (bg_enabled) > count(*) / 2 as bg_enabled, median(font_size) filter (confidence > 0.3) as ms, sum(confidence) / count(*) as confidence
  from style_frames group by 1),
colours as (select video_id, text_color, row_number() over (partition by video_id order by count(*) desc, min(frame_no), text_color desc) as r from style_frames
  where confidence > 0.3 group by video_id, text_color)
select video_id, coalesce(c.text_color, bc) as text_color, coalesce(cast(floor(ms) as int), bs) as font_size, bg_enabled, round(confidence, 9) as confidence
from best join top using (video_id) left join (select * from colours where r = 1) c using (video_id)""")
def merged_styles(spark, sf):
    colours = F.array(*map(F.lit, ("white", "black", "gold", "red")))
    rows = X.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 300).alias("video_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_no"),
        F.get(colours, (F.col("l_partkey") % 4).cast("int")).alias("text_color"), (F.col("l_suppkey") % 3 == 0).alias("bg_enabled"),
        (20 + F.col("l_partkey") % 40).cast("int").alias("font_size"), (F.col("l_quantity").cast("double") / 64).alias("confidence"),
    )
    return audio.merge_styles(rows, ["video_id"]).withColumn("confidence", F.round("confidence", 9))
