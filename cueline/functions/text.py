"""Text expressions. All are Columns of built-in functions; none is a UDF."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueline.params import (
    ALREADY_PUNCTUATED,
    CLAUSE_MARKS,
    DISPLAY_PUNCTUATION,
    ZHU_COMPOUNDS,
    SubtitleParams,
)


def char_class(chars: str) -> str:
    """A regex class of exactly these characters."""
    return "[" + "".join(dict.fromkeys(re.sub(r"([\\\]\[^\-&])", r"\\\1", c) for c in chars)) + "]"


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def counted(text: Column, count_class: str) -> Column:
    """Number of characters in the counted class: what is missing once runs of it are
    taken out, which makes no value for each of them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{count_class})+", ""))


def speed(chars: Column, duration_ms: Column, when_zero: float = 999.0) -> Column:
    """Characters per second; ``when_zero`` where there is no duration."""
    return F.when(duration_ms > 0, chars / (duration_ms / F.lit(1000.0))).otherwise(F.lit(when_zero))


def ends_sentence(text: Column, marks: str) -> Column:
    return strip(text).rlike(char_class(marks) + r"\z")


def map_characters(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """One-to-one character map, such as traditional to simplified."""
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def replace_except(text: Column, wrong: str, correct: str, keep: Sequence[str]) -> Column:
    """Replace ``wrong`` except inside the protected words of ``keep``.

    Protected words are claimed in list order. A private-use character per
    word stands in for the claimed occurrences meanwhile.
    """
    marks = [chr(0xE000 + i) for i in range(len(keep))]
    for word, mark in zip(keep, marks):
        text = F.replace(text, F.lit(word), F.lit(mark))
    text = F.replace(text, F.lit(wrong), F.lit(correct))
    for word, mark in zip(keep, marks):
        text = F.replace(text, F.lit(mark), F.lit(word))
    return text


def zhu_to_zhe(text: Column) -> Column:
    """著 becomes 着 outside the compounds that keep it."""
    return replace_except(text, "著", "着", ZHU_COMPOUNDS)


def normalise_short(text: Column, char_map: Sequence[tuple[str, str]]) -> Column:
    return zhu_to_zhe(map_characters(text, char_map))


def clean(text: Column, marks: str = CLAUSE_MARKS) -> Column:
    """No white space, no leading clause marks, no repeated comma or full stop."""
    text = F.regexp_replace(text, r"(?U)\s+", "")
    text = F.regexp_replace(text, f"^{char_class(marks)}+", "")
    text = F.regexp_replace(text, "，{2,}", "，")
    return F.regexp_replace(text, "。{2,}", "。")


def single_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def _ends_with(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("(?:" + "|".join(re.escape(w) for w in words) + r")\z")


def smart_punctuation(
    text: Column,
    next_text: Column,
    duration_s: Column,
    gap_s: Column,
    is_last: Column,
    params: SubtitleParams = SubtitleParams(),
) -> Column:
    """Close a subtitle line with the mark its ending, gap and successor ask for.

    The first connective of the list that opens the next line decides; only
    the ``comma_connectives`` force a comma.
    """
    text = strip(text)
    opener = F.lit(None).cast("string")
    for word in reversed(params.connectives):
        opener = F.when(F.coalesce(next_text, F.lit("")).startswith(word), F.lit(word)).otherwise(opener)
    comma_next = F.coalesce(opener.isin(*params.comma_connectives), F.lit(False))
    mark = (
        F.when(_ends_with(text, params.question_endings), "？")
        .when(_ends_with(text, params.exclamation_endings), "！")
        .when(is_last | (gap_s > 1.5), "。")
        .when(comma_next, "，")
        .when(duration_s > 4.0, "。")
        .otherwise("，")
    )
    closed = (text == "") | text.rlike(char_class(ALREADY_PUNCTUATED) + r"\z")
    return F.when(closed, text).otherwise(F.concat(text, mark))


def fit_line(text: Column, max_chars: Column | int, marks: str = CLAUSE_MARKS) -> Column:
    """Cut to one line: after the last clause mark near the limit, else at the limit.

    The last mark within ``max_chars + 3`` characters decides; when it lies
    past the limit the line is cut hard at the limit.
    """
    limit = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    text = clean(single_line(text), marks)
    head = F.substring(text, F.lit(1), limit + 3)
    upto = F.length(F.regexp_extract(head, f"(?s)^(.*{char_class(marks)})", 1))
    return (
        F.when(F.length(text) <= limit, text)
        .when((upto > 0) & (upto <= limit), F.substring(text, F.lit(1), upto))
        .otherwise(F.substring(text, F.lit(1), limit))
    )


def strip_display_punctuation(text: Column) -> Column:
    return F.translate(text, DISPLAY_PUNCTUATION, "")


def line_limit(duration_s: Column, max_chars: int) -> Column:
    """Characters readable in the time shown: 4 a second, at least 4, at most the limit."""
    readable = F.greatest(F.lit(4), (duration_s * 4).cast("int"))
    return F.when(duration_s > 0, F.least(F.lit(max_chars), readable)).otherwise(F.lit(max_chars))


def display_text(
    text: Column,
    next_text: Column,
    duration_s: Column,
    gap_s: Column,
    is_last: Column,
    params: SubtitleParams = SubtitleParams(),
    strip_punctuation: bool = True,
) -> Column:
    """From corrected text to the line shown: clean, punctuate, fit, strip."""
    text = smart_punctuation(clean(text, params.clause_marks), next_text, duration_s, gap_s, is_last, params)
    text = fit_line(text, line_limit(duration_s, params.max_chars), params.clause_marks)
    return strip_display_punctuation(text) if strip_punctuation else text


def pixel_width(text: Column, font_size: int) -> Column:
    """Estimated width: 0.673 of the size per CJK character, 0.37 per letter or
    digit, 0.2 per space, 0.4 otherwise, each rounded down."""
    wide = F.regexp_count(text, F.lit("[一-鿿　-〿＀-￯]"))
    narrow = F.regexp_count(text, F.lit("[A-Za-z0-9]"))
    blank = F.regexp_count(text, F.lit(" "))
    other = F.length(text) - wide - narrow - blank
    return (
        wide * int(font_size * 0.673)
        + narrow * int(font_size * 0.37)
        + blank * int(font_size * 0.2)
        + other * int(font_size * 0.4)
    )


def wider_than_frame(text: Column, font_size: int, frame_width: int) -> Column:
    """Wider than 85 % of the frame."""
    return pixel_width(text, font_size) > int(frame_width * 0.85)


def strip_full_stop(text: Column, mark: str = "。") -> Column:
    return F.when(text.endswith(mark), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


_BREAK = r"[，。！？、；：“”‘’（）\s,]"


def two_lines(text: Column, max_chars: int = 15, max_lines: int = 2) -> Column:
    """Array of display lines.

    Short text is one line. Text that fits ``max_lines`` breaks in two, after
    the break mark nearest the middle (the earlier one on a tie, and only if
    nearer than the break found so far). Longer text is cut line by line after
    the last mark within five characters past the limit; what does not fit the
    last line is dropped.
    """
    length = F.length(text)
    middle = F.floor(length / 2).cast("int")
    is_mark = lambda i: F.substring(text, i + 1, F.lit(1)).rlike("(?U)" + _BREAK)
    marks = F.filter(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), is_mark)
    cut = F.aggregate(
        marks,
        middle,
        lambda best, at: F.when(F.abs(at - middle) < F.abs(best - middle), at + 1).otherwise(best),
    )
    halves = F.array(F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, length))
    lines, rest = [], text
    for _ in range(max_lines):
        head = F.substring(rest, 1, max_chars + 5)
        upto = F.length(F.regexp_extract(head, f"(?sU)^(.*{_BREAK})", 1))
        size = F.when(F.length(rest) <= max_chars, F.length(rest)).when(upto > 0, upto).otherwise(F.lit(max_chars))
        lines.append(F.when(rest != "", F.substring(rest, F.lit(1), size)))
        rest = F.substring(rest, size + 1, length)
    return (
        F.when(length <= max_chars, F.array(text))
        .when(length <= max_chars * max_lines, halves)
        .otherwise(F.array_compact(F.array(*lines)))
    )


def has_any(text: Column, chars: str) -> Column:
    return text.rlike(char_class(chars))


def python_round(value: Column, digits: int) -> Column:
    """Round half to even, as the report fields do."""
    return F.bround(value, digits)
