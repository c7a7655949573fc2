"""SRT and ASS time codes, aspect ratios and resolutions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(ms: Column, modulus: int | None, unit: int) -> Column:
    """Whole units, towards zero; the parts of a negative time are negative or zero."""
    left = ms % modulus if modulus else ms
    return (left / unit).cast("int")


def srt_time(ms: Column) -> Column:
    """``HH:MM:SS,mmm``, truncating."""
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        _part(ms, None, 3_600_000), _part(ms, 3_600_000, 60_000), _part(ms, 60_000, 1000), _part(ms, 1000, 1),
    )


def ass_time(ms: Column) -> Column:
    """``H:MM:SS.cc``, truncating."""
    return F.format_string(
        "%d:%02d:%02d.%02d",
        _part(ms, None, 3_600_000), _part(ms, 3_600_000, 60_000), _part(ms, 60_000, 1000), _part(ms, 1000, 10),
    )


def _number(code: Column, group: int, pattern: str) -> Column:
    return F.regexp_extract(code, pattern, group).try_cast("bigint")


def parse_srt_time(code: Column) -> Column:
    """Milliseconds, or NULL where the code is malformed. Parts may be negative, as :func:`srt_time` writes them."""
    p = r"^\s*(-?\d+)[:,](-?\d+)[:,](-?\d+)[:,](-?\d+)"
    n = [_number(code, i, p) for i in range(1, 5)]
    return n[0] * 3_600_000 + n[1] * 60_000 + n[2] * 1000 + n[3]


def parse_ass_time(code: Column) -> Column:
    p = r"^\s*(-?\d+)[:.](-?\d+)[:.](-?\d+)[:.](-?\d+)"
    n = [_number(code, i, p) for i in range(1, 5)]
    return n[0] * 3_600_000 + n[1] * 60_000 + n[2] * 1000 + n[3] * 10


def srt_block(index: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    """One cue: number, times, text and a closing newline."""
    return F.concat(
        index.cast("string"), F.lit("\n"), srt_time(start_ms), F.lit(" --> "), srt_time(end_ms),
        F.lit("\n"), text, F.lit("\n"),
    )


def ass_dialogue(start_ms: Column, end_ms: Column, text: Column, style: str = "Default") -> Column:
    return F.concat(
        F.lit("Dialogue: 0,"), ass_time(start_ms), F.lit(","), ass_time(end_ms),
        F.lit(f",{style},,0,0,0,,"), text,
    )


def aspect_ratio(text: Column) -> Column:
    """``16:9``, ``16x9`` or ``16/9`` as a struct; 16 by 9 where malformed."""
    width = F.regexp_extract(text, r"^\s*(\d+)\s*[:x/]\s*(\d+)\s*$", 1).try_cast("int")
    height = F.regexp_extract(text, r"^\s*(\d+)\s*[:x/]\s*(\d+)\s*$", 2).try_cast("int")
    bad = width.isNull() | height.isNull()
    return F.struct(
        F.when(bad, 16).otherwise(width).alias("width"), F.when(bad, 9).otherwise(height).alias("height")
    )


def resolution(text: Column) -> Column:
    return F.struct(
        F.regexp_extract(text, r"^(\d+)x(\d+)$", 1).try_cast("int").alias("width"),
        F.regexp_extract(text, r"^(\d+)x(\d+)$", 2).try_cast("int").alias("height"),
    )
