"""Topics: segmentation, keywords, clip and version planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.functions.text import ellipsis
from cueline.operators.cuts import cut_runs
from cueline.operators.ordered import dense_position, over_neighbours
from cueline.params import TopicParams

SUMMARY_CHARS = 200


def after_silence(df: DataFrame, keys: Sequence[str], params: TopicParams, pos: str = "pos", **options) -> DataFrame:
    """Flag rows whose predecessor ends where some silence starts.

    The silence starts are matched by value, as a set, so a row counts even if
    the silence follows another row that ends at the same time.
    """
    rows = over_neighbours(df, keys, pos, {"_prev_end": lambda w: F.lag("end_ms").over(w)}, before=1, **options)
    starts = (
        rows.where(F.col("start_ms") - F.col("_prev_end") >= params.silence_s * 1000)
        .select(*keys, "_prev_end").distinct().withColumn("_silence", F.lit(True))
    )
    return (
        rows.join(starts, [*keys, "_prev_end"], "left")
        .withColumn("after_silence", F.coalesce("_silence", F.lit(False)))
        .drop("_silence", "_prev_end")
    )


def segment_topics(
    df: DataFrame, keys: Sequence[str], params: TopicParams = TopicParams(), pos: str = "pos", **options
) -> DataFrame:
    """Segments with ``topic_no`` (1, 2, …) and ``topic_start``, the first ``pos`` of the topic.

    A row opens a new topic if it follows a silence and enough speech was collected
    since the last cut, or if too much was.
    """
    flagged = after_silence(df, keys, params, pos).withColumn("_length", F.col("end_ms") - F.col("start_ms"))
    low, high = params.min_topic_s * 1000, params.max_topic_s * 1000
    rows = cut_runs(flagged, keys, pos, "_length", "after_silence", low, high, "topic_no", "topic_start", **options)
    return rows.drop("after_silence", "_length")


def keyword_counts(df: DataFrame, keys: Sequence[str], params: TopicParams = TopicParams(), pos: str = "pos", text: str = "text") -> DataFrame:
    """Words per key with their count and first place; stop words are left out.

    Words are greedy disjoint runs of the word pattern, found within each row.
    Counting is by map-side partial sums, so a frequent word does not travel.
    The place is (row, word in the row), for rows of any length."""
    words = df.select(
        *keys, F.col(pos).alias("_row"),
        F.posexplode(F.regexp_extract_all(F.col(text), F.lit(params.word_pattern), F.lit(0))).alias("_at", "word"),
    ).where(~F.col("word").isin(*params.stop_words))
    return words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "_at")).alias("first_at"))


def top_keywords(df: DataFrame, keys: Sequence[str], k: int = 10, params: TopicParams = TopicParams(), pos: str = "pos", text: str = "text") -> DataFrame:
    """The ``k`` most frequent words per key; earlier first occurrence wins a tie."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_at")
    ranked = keyword_counts(df, keys, params, pos, text).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select(*keys, F.col("rank").cast("long").alias("rank"), "word", "n")


def _joined_head(rows: DataFrame, keys: Sequence[str], order: str, chars: int) -> DataFrame:
    """First ``chars`` characters of the texts joined by blanks. At most
    ``chars`` + 1 rows per key are collected: each adds a character."""
    head = rows.where(F.col("_rank") <= chars).select(*keys, order, F.left("text", F.lit(chars + 1)).alias("_t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda p: p["_t"])
    return head.groupBy(*keys).agg(F.left(F.array_join(parts, " "), F.lit(chars)).alias("head"))


def assemble_topics(topic_rows: DataFrame, keys: Sequence[str], params: TopicParams = TopicParams(), pos: str = "pos") -> DataFrame:
    """One row per topic: id, title, bounds, keywords, summary, coherence.

    Every keyword is a run of the topic's own text, so the share of keywords
    found is 1 wherever there are any.
    """
    by = [*keys, "topic_no"]
    ranked = topic_rows.withColumn("_rank", F.col(pos) - F.col("topic_start"))
    base = ranked.groupBy(*by).agg(
        F.min_by("start_ms", pos).alias("start_ms"),
        F.max_by("end_ms", pos).alias("end_ms"),
        F.count(F.lit(1)).alias("n_segments"),
        F.min_by(F.left("text", F.lit(21)), pos).alias("_first21"),
        F.min_by(F.left("text", F.lit(50)), pos).alias("first_line"),
        F.max_by(F.left("text", F.lit(50)), pos).alias("last_line"),
        (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("_chars"),
    )
    words = top_keywords(topic_rows, by, params.top_words, params, pos)
    lists = words.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda p: p["word"]).alias("_words")
    )
    rows = base.join(lists, by, "left").join(_joined_head(ranked, by, pos, SUMMARY_CHARS), by)
    found = F.col("_words").isNotNull()
    return rows.select(
        *keys, "topic_no",
        F.format_string("topic_%03d", F.col("topic_no")).alias("topic_id"),
        F.coalesce(F.get("_words", F.lit(0)), F.nullif(ellipsis(F.col("_first21"), 20), F.lit("")), F.lit(params.untitled)).alias("title"),
        "start_ms", "end_ms", "n_segments",
        F.coalesce(F.slice("_words", 1, params.kept_words), F.array().cast("array<string>")).alias("keywords"),
        F.when(F.col("_chars") > SUMMARY_CHARS, F.concat("head", F.lit("..."))).otherwise(F.col("head")).alias("summary"),
        F.when(found, F.least(F.lit(1.0), F.lit(0.7) + F.least(F.lit(1.0), F.col("n_segments") / 10) * 0.3))
        .otherwise(F.lit(0.0)).alias("coherence"),
        "first_line", "last_line",
    )


def coherence(rows: DataFrame, keywords: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """0.7 × share of given keywords found in the texts + 0.3 × min(1, rows / 10).

    ``keywords`` has ``keys, word``. Words are looked for row by row; a row
    reports each distinct word it contains once and the hits are then merged.
    """
    keys = list(keys)
    lists = keywords.groupBy(*keys).agg(F.collect_set("word").alias("_words"))
    joined = rows.select(*keys, text).join(lists, keys, "left")
    hits = joined.select(
        *keys, F.explode_outer(F.filter(F.coalesce("_words", F.array().cast("array<string>")), lambda w: F.col(text).contains(w))).alias("_w")
    ).groupBy(*keys).agg(F.count_distinct("_w").alias("_hits"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        sizes.join(hits, keys, "left").join(lists.select(*keys, F.size("_words").alias("_k")), keys, "left")
        .select(
            *keys,
            F.when(
                F.col("_k") > 0, F.least(F.lit(1.0), F.col("_hits") / F.col("_k") * 0.7 + F.least(F.lit(1.0), F.col("_n") / 10) * 0.3)
            ).otherwise(F.lit(0.0)).alias("coherence"),
        )
    )


def clips_from_topics(topics: DataFrame) -> DataFrame:
    """One clip per topic that lasts: the same bounds, title and keywords."""
    return topics.where(F.col("end_ms") > F.col("start_ms")).withColumns(
        {
            "clip_id": F.concat(F.lit("clip_"), "topic_id"),
            "topic_ids": F.array("topic_id"),
            "description": F.left("summary", F.lit(100)),
        }
    )


def materials(clips: DataFrame, keys: Sequence[str], params: TopicParams = TopicParams()) -> DataFrame:
    """Opening and ending pieces: a tenth (at most 30 s, over 5 s) and 8 %
    (at most 20 s, over 3 s) of the clip."""
    length = F.col("end_ms") - F.col("start_ms")
    opening = F.least(F.lit(30000.0), length / 1000 * 0.1 * 1000)
    ending = F.least(F.lit(20000.0), length / 1000 * 0.08 * 1000)

    def piece(kind, category, start, end, label):
        return F.struct(
            F.concat(F.lit(f"{kind}_"), "clip_id").alias("material_id"), F.lit(kind).alias("material_type"),
            F.lit(category).alias("category"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"),
            F.concat(F.lit(label), "title").alias("label"),
        )

    start, end = F.col("start_ms"), F.col("end_ms")
    found = F.array_compact(
        F.array(
            F.when(opening > 5000, piece("opening", params.opening_category, start, start + opening.cast("long"), "开场_")),
            F.when(ending > 3000, piece("ending", params.ending_category, end - ending.cast("long"), end, "结尾_")),
        )
    )
    return clips.select(*keys, F.col("clip_id").alias("source_clip_id"), F.inline(found))


def assign_versions(topics: DataFrame, keys: Sequence[str], params: TopicParams = TopicParams()) -> DataFrame:
    """Pack topics into versions of ``max_clips``, topics with the same first
    keyword side by side in order of its first appearance. A tail smaller than
    ``min_clips`` joins the last full version. Every topic is placed once."""
    keys = list(keys)
    topics = topics.withColumn("_main", F.coalesce(F.get("keywords", F.lit(0)), F.lit(params.other)))
    firsts = topics.groupBy(*keys, "_main").agg(F.min("topic_no").alias("_first"))
    placed = topics.join(firsts, [*keys, "_main"]).withColumn("_range", F.floor(F.col("_first") / 10_000))
    numbered = dense_position(placed, keys, ["_range"], ["_first", "topic_no"], "_place", "_count")
    size, tail = params.max_clips, F.col("_count") % params.max_clips
    short_tail = (tail > 0) & (tail < params.min_clips) & (F.col("_count") > size)
    last_full = F.floor(F.col("_count") / size)
    version = F.floor(F.col("_place") / size) + 1
    return numbered.withColumn(
        "version_no", F.when(short_tail & (version > last_full), last_full).otherwise(version)
    ).drop("_main", "_range", "_first", "_count")


def plan_versions(placed: DataFrame, keys: Sequence[str], params: TopicParams = TopicParams()) -> DataFrame:
    """One row per version: theme of up to three keywords in order of first
    appearance, number of clips and their total length. A version has at most
    ``max_clips + min_clips`` topics, which bounds the collected lists."""
    by = [*keys, "version_no"]
    lasting = F.col("end_ms") > F.col("start_ms")
    packed = F.array_sort(F.collect_list(F.struct("_place", F.slice("keywords", 1, 2).alias("w"))))
    themes = F.slice(F.array_distinct(F.flatten(F.transform(packed, lambda p: p["w"]))), 1, 3)
    agg = placed.groupBy(*by).agg(
        themes.alias("themes"),
        F.count_if(lasting).alias("n_clips"),
        (F.sum(F.when(lasting, F.col("end_ms") - F.col("start_ms")).otherwise(0)) / 1000).alias("estimated_duration_s"),
    )
    theme = F.when(F.size("themes") > 0, F.array_join("themes", params.theme_separator)).otherwise(
        F.concat(F.lit("版本"), F.col("version_no").cast("string"))
    )
    return agg.select(
        *by, F.concat(F.lit("v"), F.col("version_no").cast("string"), F.lit("_"), theme).alias("version_key"),
        theme.alias("theme"), "n_clips", "estimated_duration_s",
    )
