"""Time columns, gaps, context and interval joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions.text import counted, speed
from cueline.operators.ordered import dense_position, over_neighbours, time_position
from cueline.params import SubtitleParams

CLIP_BUCKET_MS = 60_000


def with_times(df: DataFrame) -> DataFrame:
    """Seconds, minutes and durations derived from milliseconds."""
    length = F.col("end_ms") - F.col("start_ms")
    return df.withColumns(
        {
            "start_s": F.col("start_ms") / 1000,
            "end_s": F.col("end_ms") / 1000,
            "duration_ms": length,
            "duration_s": length / 1000,
            "duration_min": length / 1000 / 60,
        }
    )


def with_time_order(df: DataFrame, keys: Sequence[str], tie: str = "seg_idx") -> DataFrame:
    """Add ``pos`` (rank by start, then input order) and ``n_rows`` of the key."""
    return time_position(df, keys, "start_ms", tie, "pos", "n_rows")


def with_previous(df: DataFrame, keys: Sequence[str], pos: str = "pos", **options) -> DataFrame:
    """Add the previous row's end and text, and the gap to it."""
    rows = over_neighbours(
        df,
        keys,
        pos,
        {
            "prev_end_ms": lambda w: F.lag("end_ms").over(w),
            "prev_text": lambda w: F.lag("text").over(w),
        },
        before=1,
        **options,
    )
    return rows.withColumn("gap_ms", F.col("start_ms") - F.col("prev_end_ms"))


def with_next(df: DataFrame, keys: Sequence[str], pos: str = "pos", **options) -> DataFrame:
    """Add next text ('' at the end), gap to it in ms (0 at the end) and ``is_last``."""
    rows = over_neighbours(
        df,
        keys,
        pos,
        {"_next_start": lambda w: F.lead("start_ms").over(w), "_next_text": lambda w: F.lead("text").over(w)},
        before=0,
        after=1,
        **options,
    )
    return rows.select(
        *df.columns,
        F.coalesce("_next_text", F.lit("")).alias("next_text"),
        F.coalesce(F.col("_next_start") - F.col("end_ms"), F.lit(0)).alias("next_gap_ms"),
        F.col("_next_start").isNull().alias("is_last"),
        F.col("_next_start").alias("next_start_ms"),
    )


def with_context(
    df: DataFrame, keys: Sequence[str], pos: str = "seg_idx", width: int = 3, out: str = "context", **options
) -> DataFrame:
    """Text of the row and its ``width`` neighbours on both sides, joined by blanks."""
    offsets = range(-width, width + 1)
    names = {o: f"_text{o + width}" for o in offsets}
    rows = over_neighbours(
        df,
        keys,
        pos,
        {names[o]: (lambda w, o=o: F.lag("text", -o).over(w)) for o in offsets},
        before=width,
        after=width,
        **options,
    )
    return rows.withColumn(out, F.concat_ws(" ", *[F.col(n) for n in names.values()])).drop(*names.values())


def silences(df: DataFrame, keys: Sequence[str], min_silence_s: float = 1.5, **options) -> DataFrame:
    """Gaps of at least ``min_silence_s`` between consecutive segments in time order."""
    rows = with_previous(df, keys, **options)
    return rows.where(F.col("gap_ms") >= min_silence_s * 1000).select(
        *keys,
        F.col("prev_end_ms").alias("start_ms"),
        F.col("start_ms").alias("end_ms"),
        F.col("gap_ms").alias("duration_ms"),
        (F.col("prev_end_ms") / 1000).alias("position_s"),
    )


def rows_at(df: DataFrame, indices: Sequence[int], index: str = "seg_idx") -> DataFrame:
    return df.where(F.col(index).isin(list(indices)))


def supported_files(df: DataFrame, extensions: Sequence[str], path: str = "path") -> DataFrame:
    """Files whose extension is on the list, whatever its case."""
    return df.where(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions]))


# -- interval joins -------------------------------------------------------------------


def _size_class(start: Column, end: Column, bucket_ms: int) -> Column:
    """The least ``c`` for which ``bucket_ms * 2**c`` is not below the length."""
    length = F.greatest(start, end) - F.least(start, end)
    ratio = F.greatest(F.lit(1), F.ceil(length / bucket_ms)).cast("long")
    return F.length(F.bin(ratio - 1)).cast("int") * (ratio > 1).cast("int")


def _in_classes(df: DataFrame, start: str, end: str, other: Sequence[int], bucket_ms: int) -> DataFrame:
    """One row for each bucket that an interval touches in its own size class (``_own``)
    and in the larger ones that the other side uses; two of a class at most."""
    low, high, own = F.least(start, end), F.greatest(start, end), F.col("_class")
    larger = F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda c: c > own)

    def places(c: Column) -> Column:
        width = (F.pow(F.lit(2.0), c) * bucket_ms).cast("long")
        first, last = F.floor(low / width), F.floor(high / width)
        return F.transform(F.sequence(first, last), lambda b: F.struct(c.alias("_level"), b.alias("_bucket"), first.alias("_first")))

    levels = F.concat(F.array(own), larger)
    return df.where(low.isNotNull() & high.isNotNull()).select("*", F.inline(F.flatten(F.transform(levels, places))))


def interval_join(
    entries: DataFrame, clips: DataFrame, key: str, condition: Column, bucket_ms: int = CLIP_BUCKET_MS
) -> DataFrame:
    """Pairs of entries and clips of one key that share a stretch of time.

    Intervals fall into size classes of doubling width, from ``bucket_ms`` on. A pair meets in
    the larger class of the two, where either touches two buckets at most, and is kept in
    the first bucket that both touch. An interval therefore becomes two rows for each class
    that the other side uses, however long it is (ten years: under 50), and short ones
    stay as cheap as in one class. The classes in use, at most 64, are looked up first. Clip
    times must be named ``clip_start_ms/clip_end_ms``.
    """
    left = entries.withColumn("_class", _size_class(F.col("start_ms"), F.col("end_ms"), bucket_ms))
    right = clips.withColumn("_class", _size_class(F.col("clip_start_ms"), F.col("clip_end_ms"), bucket_ms))

    def used(df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select("_class").where("_class is not null").distinct().collect())

    left_classes, right_classes = used(left), used(right)
    left = _in_classes(left, "start_ms", "end_ms", right_classes, bucket_ms)
    right = _in_classes(right, "clip_start_ms", "clip_end_ms", left_classes, bucket_ms).withColumnsRenamed({"_class": "_clip_class", "_first": "_clip_first"})
    meets = (F.col("_level") == F.greatest("_class", "_clip_class")) & (F.col("_bucket") == F.greatest("_first", "_clip_first"))
    return left.join(right, [key, "_level", "_bucket"]).where(condition & meets).drop("_level", "_bucket", "_class", "_clip_class", "_first", "_clip_first")


def _clip_columns(clips: DataFrame) -> DataFrame:
    return clips.withColumnsRenamed({"start_ms": "clip_start_ms", "end_ms": "clip_end_ms"})


def extract_clip_entries(entries: DataFrame, clips: DataFrame, key: str = "transcript_id", min_ms: int = 500) -> DataFrame:
    """Entries that overlap a clip, clamped to it and counted from its start.

    Results shorter than half a second are dropped. ``seg_idx`` keeps the
    order of the input.
    """
    overlap = (F.col("start_ms") < F.col("clip_end_ms")) & (F.col("end_ms") > F.col("clip_start_ms"))
    rows = interval_join(entries, _clip_columns(clips), key, overlap)
    start = F.greatest("start_ms", "clip_start_ms") - F.col("clip_start_ms")
    end = F.least("end_ms", "clip_end_ms") - F.col("clip_start_ms")
    return (
        rows.withColumns({"start_ms": start, "end_ms": end})
        .where(F.col("end_ms") - F.col("start_ms") >= min_ms)
        .withColumn("duration_s", (F.col("end_ms") - F.col("start_ms")) / 1000)
        .drop("clip_start_ms", "clip_end_ms")
    )


def number_in_clip(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seg_idx",), out: str = "clip_pos", block_rows: int = 50_000
) -> DataFrame:
    """Position of each row in its clip (0, 1, …) and the clip's row count ``n_rows``."""
    blocked = rows.drop(*{"n_rows", "pos"} - set(order)).withColumn("_range", F.floor(F.col(order[0]) / block_rows))
    return dense_position(blocked, keys, ["_range"], order, out, "n_rows").drop("_range")


def slice_clip_subtitles(
    entries: DataFrame, clips: DataFrame, key: str = "transcript_id", params: SubtitleParams = SubtitleParams()
) -> DataFrame:
    """Subtitles of each clip: clamped, shifted, renumbered and retimed.

    Unlike :func:`extract_clip_entries` nothing is dropped for being short, and
    an entry wholly inside the clip counts even if it has no length.
    """
    start, end, a, b = (F.col(c) for c in ("start_ms", "end_ms", "clip_start_ms", "clip_end_ms"))
    inside = (start >= a) & (end <= b)
    rows = interval_join(entries, _clip_columns(clips), key, inside | ((start < b) & (end > a)))
    shifted = rows.withColumns(
        {
            "start_ms": F.greatest(F.lit(0), F.when(inside, start - a).otherwise(F.greatest(start, a) - a)).cast("long"),
            "end_ms": F.greatest(F.lit(0), F.when(inside, end - a).otherwise(F.least(end, b) - a)).cast("long"),
        }
    ).drop("clip_start_ms", "clip_end_ms")
    numbered = number_in_clip(shifted, [key, "clip_id"])
    timed = adjust_timing(numbered, [key, "clip_id"], "clip_pos", params)
    return timed.withColumn("index", F.col("clip_pos") + 1)


def adjust_timing(
    df: DataFrame, keys: Sequence[str], pos: str, params: SubtitleParams = SubtitleParams(), **options
) -> DataFrame:
    """Clamp every duration to the display limits, then start each entry at
    least the minimum gap after the previous end. Ends are not moved again, so
    the previous row is all that is needed."""
    length = F.col("end_ms") - F.col("start_ms")
    clamped = df.withColumn(
        "end_ms",
        F.when(length < params.min_display_s * 1000, F.col("start_ms") + params.min_display_ms)
        .when(length > params.max_display_s * 1000, F.col("start_ms") + params.max_display_ms)
        .otherwise(F.col("end_ms")),
    )
    rows = over_neighbours(clamped, keys, pos, {"_prev_end": lambda w: F.lag("end_ms").over(w)}, before=1, **options)
    gap = F.lit(params.min_gap_ms)
    return rows.withColumn(
        "start_ms",
        F.when(F.col("start_ms") - F.col("_prev_end") < gap, F.col("_prev_end") + gap).otherwise(F.col("start_ms")),
    ).drop("_prev_end")


def limit(params: SubtitleParams | Mapping[str, SubtitleParams], name: str) -> Column:
    """A limit as a Column: one value, or one per setting looked up by ``param_id``."""
    values = {getattr(p, name) for p in ([params] if isinstance(params, SubtitleParams) else params.values())}
    if len(values) == 1:
        return F.lit(values.pop())
    table = F.create_map(*[F.lit(v) for k, p in params.items() for v in (k, getattr(p, name))])
    return F.element_at(table, F.col("param_id"))


def _with_next_start(df: DataFrame, keys: Sequence[str], pos: str, **options) -> DataFrame:
    return over_neighbours(df, keys, pos, {"_next": lambda w: F.lead("start_ms").over(w)}, before=0, after=1, **options)


def trimmed_end(start: Column, end: Column, following: Column, params: SubtitleParams | Mapping[str, SubtitleParams]) -> Column:
    """The end of an entry that leaves room for the gap to the next start."""
    gap = limit(params, "min_gap_ms")
    spare = end - start - limit(params, "min_display_ms")
    trim = F.when(
        (gap > 0) & (following - end < gap) & (spare > 0),
        F.least(F.floor(gap / 2), F.floor(spare / 2)),
    ).otherwise(F.lit(0))
    return (end - trim).cast("long")


def extended_end(
    start: Column, end: Column, chars: Column, following: Column, fastest: Column, shortest: Column, guard_ms: int = 67
) -> Column:
    """The end of an entry that is shown longer when it reads too fast."""
    fast = (chars > 0) & (speed(chars, end - start) > fastest)
    needed = F.greatest((chars / fastest * 1000).cast("long"), shortest)
    wanted = F.least(start + needed, following - guard_ms)
    return F.when(fast & (wanted > end), wanted).otherwise(end)


def _trimmed(rows: DataFrame, params: SubtitleParams | Mapping[str, SubtitleParams]) -> DataFrame:
    return rows.withColumn("end_ms", trimmed_end(F.col("start_ms"), F.col("end_ms"), F.col("_next"), params))


def _extended(rows: DataFrame, params: SubtitleParams | Mapping[str, SubtitleParams], guard_ms: int) -> DataFrame:
    count_class = (params if isinstance(params, SubtitleParams) else next(iter(params.values()))).count_class
    chars = counted(F.col("text"), count_class)
    limits = limit(params, "max_speed"), limit(params, "min_display_ms")
    return rows.withColumn("end_ms", extended_end(F.col("start_ms"), F.col("end_ms"), chars, F.col("_next"), *limits, guard_ms))


def insert_gaps(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    params: SubtitleParams | Mapping[str, SubtitleParams] = SubtitleParams(),
    **options,
) -> DataFrame:
    """Trim the end of an entry that leaves less than the minimum gap, by at most
    half the gap and half of what it shows beyond the minimum."""
    return _trimmed(_with_next_start(df, keys, pos, **options), params).drop("_next")


def extend_for_readability(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    params: SubtitleParams | Mapping[str, SubtitleParams] = SubtitleParams(),
    guard_ms: int = 67,
    **options,
) -> DataFrame:
    """Show an entry longer when it reads too fast, up to shortly before the next."""
    return _extended(_with_next_start(df, keys, pos, **options), params, guard_ms).drop("_next")


def finish_timing(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    params: SubtitleParams | Mapping[str, SubtitleParams] = SubtitleParams(),
    guard_ms: int = 67,
    **options,
) -> DataFrame:
    """:func:`insert_gaps`, then :func:`extend_for_readability`, in one pass: neither
    moves a start, so both see the same next start."""
    return _extended(_trimmed(_with_next_start(df, keys, pos, **options), params), params, guard_ms).drop("_next")


def finish_beside(rows: DataFrame, params: SubtitleParams | Mapping[str, SubtitleParams] = SubtitleParams(), guard_ms: int = 67) -> DataFrame:
    """:func:`finish_timing` where each row has the previous one beside it (``prev_start_ms, prev_end_ms, prev_chars``),
    its own ``chars`` and ``next_start_ms``: both ends are finished in place. Adds the gap as :func:`with_previous` does."""
    start, before, following = F.col("start_ms"), F.col("prev_start_ms"), F.col("next_start_ms")
    limits = F.col("_fastest"), limit(params, "min_display_ms")
    rows = rows.withColumns(
        {
            "_fastest": limit(params, "max_speed"),
            "end_ms": trimmed_end(start, F.col("end_ms"), following, params),
            "prev_end_ms": trimmed_end(before, F.col("prev_end_ms"), start, params),
        }
    )
    rows = rows.withColumns(
        {
            "end_ms": extended_end(start, F.col("end_ms"), F.col("chars"), following, *limits, guard_ms),
            "prev_end_ms": extended_end(before, F.col("prev_end_ms"), F.col("prev_chars"), start, *limits, guard_ms),
        }
    )
    return rows.withColumn("gap_ms", start - F.col("prev_end_ms")).drop("_fastest")


# -- nearest silence ------------------------------------------------------------------


def snap_to_silence(
    targets: DataFrame,
    silence_points: DataFrame,
    keys: Sequence[str],
    target: str = "target_s",
    search_s: float = 1.0,
) -> DataFrame:
    """Nearest silence boundary within ``search_s`` of each target, NULL if none.

    ``silence_points`` has one boundary time ``t_s`` per row. Both sides are
    bucketed by the search range; a target looks into three buckets. The
    earlier boundary wins a tie.
    """
    bucket = F.floor(F.col(target) / search_s)
    wanted = targets.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    points = silence_points.select(*keys, "t_s", F.floor(F.col("t_s") / search_s).alias("_bucket"))
    near = wanted.join(points, [*keys, "_bucket"]).where(
        (F.col("t_s") >= F.greatest(F.lit(0.0), F.col(target) - search_s)) & (F.col("t_s") <= F.col(target) + search_s)
    )
    best = near.groupBy(*targets.columns).agg(
        F.min_by("t_s", F.struct(F.abs(F.col("t_s") - F.col(target)), F.col("t_s"))).alias("silence_s")
    )
    return targets.join(best, targets.columns, "left")


def optimise_cuts(
    clips: DataFrame,
    silence_points: DataFrame,
    keys: Sequence[str],
    clip_key: str = "clip_id",
    search_s: float = 1.0,
    padding_s: float = 0.1,
) -> DataFrame:
    """Move both ends of each clip to the nearest silence, else pad them outwards."""
    ends = clips.select(
        *keys,
        clip_key,
        F.inline(
            F.array(
                F.struct(F.lit("start").alias("side"), (F.col("start_ms") / 1000).alias("target_s")),
                F.struct(F.lit("end").alias("side"), (F.col("end_ms") / 1000).alias("target_s")),
            )
        ),
    )
    snapped = snap_to_silence(ends, silence_points, keys, search_s=search_s)
    padded = F.when(F.col("side") == "start", F.greatest(F.lit(0.0), F.col("target_s") - padding_s)).otherwise(
        F.col("target_s") + padding_s
    )
    return (
        snapped.withColumn("cut_s", F.coalesce("silence_s", padded))
        .groupBy(*keys, clip_key)
        .agg(
            F.max(F.when(F.col("side") == "start", F.col("cut_s"))).alias("cut_start_s"),
            F.max(F.when(F.col("side") == "end", F.col("cut_s"))).alias("cut_end_s"),
        )
    )
