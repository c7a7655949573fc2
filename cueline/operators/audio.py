"""Measurements of audio and style: level frames, islands, platform specs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.operators.checks import loudness_compliance
from cueline.operators.ordered import over_neighbours, running_max
from cueline.params import AudioParams

# -- Fixed values: platform specifications --------------------------------------------

PLATFORM_FIELDS = (
    "platform", "resolution", "video_bitrate", "fps", "video_codec", "pixel_format", "container",
    "audio_codec", "audio_bitrate", "sample_rate", "channels", "target_lufs", "true_peak",
    "max_file_size_gb", "max_duration_s", "max_subtitle_chars",
)
PLATFORMS = (
    ("bilibili", "1920x1080", "8M", 30, "libx264", "yuv420p", "mp4", "aac", "192k", 48000, 2, -14.0, -1.0, 8.0, None, None),
    ("douyin", "1080x1920", "6M", 30, "libx264", "yuv420p", "mp4", "aac", "128k", 48000, 2, -14.0, -1.0, None, 900.0, 12),
    ("youtube", "1920x1080", "10M", 30, "libx264", "yuv420p", "mp4", "aac", "192k", 48000, 2, -14.0, -1.0, None, None, None),
    ("xiaoyuzhou", None, None, None, None, None, None, "aac", "192k", 48000, 2, -16.0, -1.0, None, None, None),
    ("apple_podcasts", None, None, None, None, None, None, "aac", "192k", 48000, 2, -16.0, -1.0, None, None, None),
    ("archive", None, None, None, "prores_ks", "yuv422p10le", "mov", "pcm_s24le", None, 48000, 2, None, None, None, None, None),
)
PLATFORM_TYPES = (
    "string", "string", "string", "int", "string", "string", "string", "string", "string", "int", "int",
    "double", "double", "double", "double", "int",
)
EXPORT_DEFAULTS = {
    "resolution": "1920x1080", "video_bitrate": "8M", "fps": 30, "video_codec": "libx264", "pixel_format": "yuv420p",
    "audio_codec": "aac", "audio_bitrate": "192k", "sample_rate": 48000, "channels": 2,
}


def platform_array(names: Sequence[str]) -> Column:
    """The requested platforms as an array of specs; unknown names have NULL fields."""
    known = {p[0]: p for p in PLATFORMS}
    rows = []
    for name in names:
        values = known.get(name, (name,) + (None,) * (len(PLATFORM_FIELDS) - 1))
        fields = [F.lit(v).cast(t).alias(f) for f, t, v in zip(PLATFORM_FIELDS, PLATFORM_TYPES, values)]
        rows.append(F.struct(*fields, F.lit(name in known).alias("known")))
    return F.array(*rows)


def platform_fan_out(assets: DataFrame, platforms: Sequence[str]) -> DataFrame:
    """Every asset once per requested platform, with the export settings.

    The specs are a literal, so the fan-out is a projection. Missing settings
    take the export defaults; an unknown platform gives ``success`` false.
    """
    rows = assets.select("*", F.inline(platform_array(platforms)))
    filled = {
        c: F.when(F.col("known"), F.coalesce(F.col(c), F.lit(v))) for c, v in EXPORT_DEFAULTS.items()
    }
    return rows.withColumns(filled).withColumnRenamed("known", "success")


def breaks_platform_limits(rows: DataFrame, duration_s: str = "duration_s") -> DataFrame:
    """Rows longer than the platform allows."""
    return rows.where(F.col(duration_s) > F.col("max_duration_s"))


def broken_limits(duration_s: Column | None = None, size_gb: Column | None = None, subtitle_chars: Column | None = None) -> Column:
    """The names of a platform's limits that a row of :func:`platform_fan_out` exceeds.

    ``subtitle_chars`` is the length of the longest subtitle line. A limit that the
    platform does not state, or a measure that is null, breaks nothing.
    """
    pairs = (("max_duration_s", duration_s), ("max_file_size_gb", size_gb), ("max_subtitle_chars", subtitle_chars))
    return F.array_compact(F.array(*[F.when(value > F.col(limit), F.lit(limit)) for limit, value in pairs if value is not None]))


def quiet_runs(
    frames: DataFrame, keys: Sequence[str], threshold_db: float, pos: str = "frame_idx", frame_ms: int = 100, **options
) -> DataFrame:
    """Maximal runs of frames below the threshold, with start and end in ms."""
    keys = list(keys)
    quiet = frames.withColumn("_q", F.col("rms_db") < threshold_db)
    rows = over_neighbours(quiet, keys, pos, {"_before": lambda w: F.lag("_q").over(w)}, before=1, **options)
    rows = rows.where("_q").withColumn("_start", F.when(~F.coalesce("_before", F.lit(False)), F.col(pos)))
    rows = running_max(rows, keys, pos, {"run": "_start"}, **options)
    # frames of one quiet run; partial sums keep a long silence in many tasks
    runs = rows.groupBy(*keys, "run").agg(
        F.min("t_ms").alias("start_ms"), (F.max("t_ms") + frame_ms).alias("end_ms"), F.count(F.lit(1)).alias("n_frames")
    )
    return runs.drop("run")


def breaths(frames: DataFrame, keys: Sequence[str], params: AudioParams = AudioParams(), **options) -> DataFrame:
    """Quiet runs of breath length, with the duration rounded to milliseconds."""
    runs = quiet_runs(frames, keys, params.breath_db, frame_ms=params.frame_ms, **options)
    length = F.col("end_ms") - F.col("start_ms")
    return runs.where((length >= params.min_breath_s * 1000) & (length <= params.max_breath_s * 1000)).select(
        *keys, (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"),
        F.bround(length / 1000, 3).alias("duration_s"),
    )


def silence_boundaries(frames: DataFrame, keys: Sequence[str], params: AudioParams = AudioParams(), **options) -> DataFrame:
    """Start and end times of silences long enough to cut at."""
    runs = quiet_runs(frames, keys, params.silence_db, frame_ms=params.frame_ms, **options).where(
        F.col("end_ms") - F.col("start_ms") >= params.min_silence_s * 1000
    )
    return runs.select(*keys, F.explode(F.array("start_ms", "end_ms")).alias("_t")).select(
        *keys, (F.col("_t") / 1000).alias("t_s")
    )


def abrupt_edges(frames: DataFrame, keys: Sequence[str], order: str = "frame_idx", margin_db: float = 15.0) -> DataFrame:
    """Files whose first or last frame is far louder than the frames next to it.

    Frames without level are dropped. With more than five frames the reference
    level is the mean of frames two to five from that end, else of all; at
    least three are needed. Only five frames per end and file are shuffled:
    the rank filter is applied before the exchange as well as after it.
    """
    keys = list(keys)
    heard = frames.where(F.col("rms_db").isNotNull() & (F.col("rms_db") > float("-inf")))
    totals = heard.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))

    def edge(direction: Column, issue_type: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(direction))
        near = heard.select(*keys, order, "rms_db").withColumn("_r", rank).where("_r <= 5")
        level = near.groupBy(*keys).agg(
            F.max(F.when(F.col("_r") == 1, F.col("rms_db"))).alias("edge_db"),
            (F.sum(F.when(F.col("_r") > 1, F.col("rms_db"))) / 4).alias("_next"),
            (F.sum("rms_db") / F.count(F.lit(1))).alias("_all"),
        )
        rows = level.join(totals, keys).where("_n > 2")
        mean = F.when(F.col("_n") > 5, F.col("_next")).otherwise(F.col("_all"))
        return rows.withColumn("mean_db", mean).where(F.col("edge_db") > F.col("mean_db") + margin_db).select(
            *keys, F.lit(issue_type).alias("issue_type"), F.lit("warning").alias("severity"), "edge_db", "mean_db"
        )

    return edge(F.col(order).asc(), "abrupt_start").unionByName(edge(F.col(order).desc(), "abrupt_end"))


def file_issues(
    loudness: DataFrame, frames: DataFrame, keys: Sequence[str], params: AudioParams = AudioParams(), **options
) -> DataFrame:
    """All issues that the verification of audio files counts, as ``keys, issue_type,
    severity, value``: loudness, true peak and range, and abrupt edges with the level
    of the edge. ``options`` go to :func:`abrupt_edges`."""
    keys = list(keys)
    measured = loudness.select(*keys, F.inline(loudness_compliance(params))).drop("detail")
    edges = abrupt_edges(frames, keys, **options)
    return measured.unionByName(edges.select(*keys, "issue_type", "severity", F.col("edge_db").alias("value")))


def merge_styles(frames: DataFrame, keys: Sequence[str], trusted: float = 0.3) -> DataFrame:
    """One style per video from its frames: the most confident frame, with the
    commonest colour and median size of the trusted frames, the majority of the
    background flags and the mean confidence."""
    keys = list(keys)
    sure = F.col("confidence") > trusted
    base = frames.groupBy(*keys).agg(
        F.max_by(F.struct("text_color", "font_size"), F.struct("confidence", -F.col("frame_no"), "text_color", "font_size")).alias("_best"),
        (F.count_if("bg_enabled") > F.count(F.lit(1)) / 2).alias("bg_enabled"),
        F.median(F.when(sure, F.col("font_size"))).alias("_size"),
        F.avg("confidence").alias("confidence"),
    )
    colours = frames.where(sure).groupBy(*keys, "text_color").agg(F.count(F.lit(1)).alias("_n"), F.min("frame_no").alias("_first"))
    common = colours.groupBy(*keys).agg(F.max_by("text_color", F.struct("_n", -F.col("_first"), "text_color")).alias("_colour"))
    return base.join(common, keys, "left").select(
        *keys,
        F.coalesce("_colour", F.col("_best.text_color")).alias("text_color"),
        F.coalesce(F.col("_size").cast("int"), F.col("_best.font_size")).alias("font_size"),
        "bg_enabled", "confidence",
    )
