"""Correction rules: loading, applying and finding violations.

A rule list travels inside the plan as a literal and is applied without a join,
since rules apply in order to each other's results. For detection alone, a rule
table may stay a DataFrame and is matched by an equi-join on the substrings of
the text that have a rule's length; both ways find the same hits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.text import map_characters, zhu_to_zhe
from cueline.params import RULE_CATEGORIES

CHAINED_RULES = 40
"""Most replacements written as one expression each; more become a loop over an array."""


@dataclass(frozen=True)
class Rules:
    """Rule lists in application order."""

    literal: tuple[tuple[str, str], ...] = ()
    regex: tuple[tuple[str, str], ...] = ()
    semantic: tuple[tuple[str, str | None, str | None], ...] = ()
    keywords: tuple[tuple[str, tuple[str, ...]], ...] = ()
    disambiguation: tuple[tuple[tuple[str, ...], tuple[tuple[str, str], ...]], ...] = ()
    dictionary: tuple[str, ...] = ()
    char_map: tuple[tuple[str, str], ...] = ()
    variants: tuple[tuple[str, str], ...] = field(default=())
    phonetic: tuple[tuple[str, str], ...] = field(default=())


def flatten_rules(rules: DataFrame, categories: Sequence[str] = RULE_CATEGORIES) -> DataFrame:
    """One row per ``wrong``: a later category overrides the value, the first
    occurrence fixes the place. Input ``category, rule_order, wrong, correct``;
    rows of unknown categories are left out."""
    rank = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    at = F.struct(rank.alias("rank"), F.col("rule_order"))
    return (
        rules.where(rank > 0)
        .groupBy("wrong")
        .agg(F.max_by("correct", at).alias("correct"), F.min(at).alias("at"))
        .select("wrong", "correct", F.col("at.rank").alias("category_rank"), F.col("at.rule_order").alias("rule_order"))
    )


def usable_regex(rules: DataFrame) -> DataFrame:
    return rules.where("pattern is not null and replacement is not null")


def usable_semantic(rules: DataFrame) -> DataFrame:
    return rules.where("pattern is not null")


def inline_rules(flat: DataFrame) -> list[tuple[str, str]]:
    """The flattened table as a list in order, whatever its length."""
    return [(r.wrong, r.correct) for r in flat.orderBy("category_rank", "rule_order", "wrong").collect()]


def rules_from_tables(
    literal: DataFrame | None = None,
    regex: DataFrame | None = None,
    semantic: DataFrame | None = None,
    keywords: DataFrame | None = None,
    disambiguation: DataFrame | None = None,
    **others,
) -> Rules:
    """Rules from tables: ``literal`` as for :func:`flatten_rules`, the others by ``rule_order``.

    ``keywords`` has ``domain, word``, ``disambiguation`` ``rule_no, cues, wrong, correct``
    with ``cues`` an array. Rows without their required fields are left out.
    """

    def ordered(table: DataFrame | None, *columns: str) -> list[tuple]:
        return [] if table is None else [tuple(r[c] for c in columns) for r in table.orderBy("rule_order").collect()]

    domains: dict[str, list[str]] = {}
    for domain, word in ordered(keywords, "domain", "word"):
        domains.setdefault(domain, []).append(word)
    fixes: dict[int, tuple[tuple[str, ...], list[tuple[str, str]]]] = {}
    for number, cues, wrong, correct in ordered(disambiguation, "rule_no", "cues", "wrong", "correct"):
        fixes.setdefault(number, (tuple(cues), []))[1].append((wrong, correct))
    return Rules(
        literal=tuple(inline_rules(flatten_rules(literal))) if literal is not None else (),
        regex=tuple(ordered(None if regex is None else usable_regex(regex), "pattern", "replacement")),
        semantic=tuple(ordered(None if semantic is None else usable_semantic(semantic), "pattern", "correction", "description")),
        keywords=tuple((d, tuple(w)) for d, w in domains.items()),
        disambiguation=tuple((cues, tuple(pairs)) for cues, pairs in fixes.values()),
        **others,
    )


def java_replacement(replacement: str) -> str:
    """A ``\\1``-style replacement in the ``$1`` style of Java regexes."""
    escaped = replacement.replace("$", r"\$")
    return re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: "${%s}" % m[1] if m[1] and not m[1].isdigit() else "$" + (m[1] or m[2]), escaped)


def apply_literal(text: Column, rules: Sequence[tuple[str, str]], keep_noops: bool = False) -> Column:
    """Replace in rule order; later rules see earlier results."""
    active = [(w, c) for w, c in rules if w and w != c]
    if not active:
        return text
    if len(active) <= CHAINED_RULES:
        for wrong, correct in active:
            text = F.replace(text, F.lit(wrong), F.lit(correct))
        return text
    return F.aggregate(_pairs(active), text, lambda acc, r: F.replace(acc, r["wrong"], r["correct"]))


def apply_regex(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, java_replacement(replacement))
    return text


def apply_to_fixpoint(
    text: Column, literal: Sequence[tuple[str, str]], regex: Sequence[tuple[str, str]] = (), passes: int = 3
) -> Column:
    """Longest rule first, up to three passes, then the regex rules. A pass over
    stable text changes nothing, so no early exit is needed."""
    ordered = sorted([(w, c) for w, c in literal if w and w != c], key=lambda r: -len(r[0]))
    for _ in range(passes if ordered else 0):
        text = apply_literal(text, ordered)
    return apply_regex(text, regex)


def normalise(text: Column, rules: Rules) -> Column:
    """Characters, variants, literal rules, phonetic rules, then 著 to 着."""
    if rules.char_map:
        text = map_characters(text, rules.char_map)
    text = apply_literal(text, rules.variants)
    text = apply_literal(text, rules.literal)
    return zhu_to_zhe(apply_to_fixpoint(text, rules.phonetic, rules.regex))


# -- violations as arrays of structs ---------------------------------------------

ISSUE = "array<struct<issue_type:string,severity:string,value:double,detail:string>>"


def issue(issue_type: Column | str, severity: str, value: Column | None = None, detail: Column | None = None) -> Column:
    kind = F.lit(issue_type) if isinstance(issue_type, str) else issue_type
    return F.struct(
        kind.alias("issue_type"),
        F.lit(severity).alias("severity"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def no_issues() -> Column:
    return F.array().cast(ISSUE)


def _pairs(rules: Sequence[tuple[str, str]]) -> Column:
    """The rules as one literal array; the optimiser parses the text once."""
    text = json.dumps([{"wrong": w, "correct": c} for w, c in rules])
    return F.from_json(F.lit(text), "array<struct<wrong:string,correct:string>>")


def literal_hits(
    text: Column, rules: Sequence[tuple[str, str]], issue_type: str = "errata_violation", unless_corrected: bool = False
) -> Column:
    """One critical issue per rule whose ``wrong`` occurs in the text."""
    active = [(w, c) for w, c in rules if w != c]
    if not active:
        return no_issues()

    def hit(wrong, correct):
        found = text.contains(wrong)
        return found & ~text.contains(correct) if unless_corrected else found

    def row(detail):
        return issue(issue_type, "critical", None, detail)

    if len(active) <= CHAINED_RULES:  # compiled code; the loop over an array is interpreted
        return F.array_compact(F.array(*[F.when(hit(w, c), row(F.lit(f"{w}→{c}"))) for w, c in active]))
    return F.transform(
        F.filter(_pairs(active), lambda r: hit(r["wrong"], r["correct"])),
        lambda r: row(F.concat(r["wrong"], F.lit("→"), r["correct"])),
    )


def regex_hits(text: Column, rules: Sequence[tuple[str, str]], issue_type: str = "asr_phonetic_error") -> Column:
    """One critical issue per matching pattern, with the first match."""
    found = [
        F.when(text.rlike(p), issue(issue_type, "critical", None, F.concat(F.regexp_extract(text, p, 0), F.lit("→"), F.lit(r))))
        for p, r in rules
    ]
    return F.array_compact(F.array(*found)) if found else no_issues()


def semantic_hits(body: Column, rules: Sequence[tuple[str, str | None, str | None]]) -> Column:
    """Critical ``semantic_anomaly`` per pattern that has a correction and matches the stripped text."""
    found = [
        F.when((body != "") & body.rlike(p), issue("semantic_anomaly", "critical", None, F.lit(f"{p}→{c}")))
        for p, c, _ in rules
        if c is not None
    ]
    return F.array_compact(F.array(*found)) if found else no_issues()


def suspicious_hits(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Info rows for patterns that come with a hint only."""
    found = [F.when(text.rlike(p), issue("suspicious_pattern", "info", None, F.lit(h))) for p, h in rules]
    return F.array_compact(F.array(*found)) if found else no_issues()


def mentions_any(context: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | context.contains(word)
    return hit


def contextual_hits(body: Column, context: Column, rules: Rules) -> Column:
    """Rules that apply only where the surrounding lines mention a domain or cue.

    ``contextual_<domain>_errata`` needs a domain keyword in the context and the
    correction absent from the text; ``contextual_disambiguation`` needs a cue.
    ``body`` is the stripped text.
    """
    parts = [
        F.when(mentions_any(context, words), literal_hits(body, rules.literal, f"contextual_{domain}_errata", True))
        for domain, words in rules.keywords
    ] + [
        F.when(mentions_any(context, cues), literal_hits(body, [(w, c) for w, c in fixes], "contextual_disambiguation"))
        for cues, fixes in rules.disambiguation
    ]
    if not parts:
        return no_issues()
    return F.when(body == "", no_issues()).otherwise(F.flatten(F.array_compact(F.array(*parts))))


def rule_hits_by_join(
    df: DataFrame, rules: DataFrame, text: str = "text", lengths: Sequence[int] | None = None, unless_corrected: bool = False
) -> DataFrame:
    """Literal hits of a rule table of any size: rows of ``df`` with ``wrong, correct``.

    Every distinct substring of a row whose length is some rule's length is
    joined to the rules by equality. The work is text length × number of
    lengths, independent of the number of rules. A frequent substring is split
    by the adaptive skew join, or the rules are broadcast when they are small.
    """
    active = rules.where("wrong <> correct and wrong <> ''").select("wrong", "correct")
    if lengths is None:
        lengths = sorted(r.n for r in active.select(F.length("wrong").alias("n")).distinct().collect())
    if not lengths:
        return df.withColumns({"wrong": F.lit(""), "correct": F.lit("")}).where(F.lit(False))
    body = F.col(text)

    def substrings(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(body) - (n - 1))
        found = F.transform(starts, lambda i: F.substring(body, i, F.lit(n)))
        return F.when(F.length(body) >= n, found).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(substrings, lengths)))
    hits = df.withColumn("wrong", F.explode(F.array_distinct(grams))).join(active, "wrong")
    return hits.where(~body.contains(F.col("correct"))) if unless_corrected else hits


# -- words -------------------------------------------------------------------------


def tokens(text: Column, dictionary: Sequence[str], max_len: int = 6) -> Column:
    """Greedy longest-match words; characters outside the dictionary stand alone."""
    words = sorted({w for w in dictionary if 2 <= len(w) <= max_len}, key=lambda w: (-len(w), w))
    return F.regexp_extract_all(text, F.lit("(?s)" + "|".join([*map(re.escape, words), "."])), F.lit(0))


def word_dictionary(rules: Rules, extra: Sequence[str] = ()) -> tuple[str, ...]:
    """Corrections and extra words of at least two characters."""
    words = [c for _, c in (*rules.literal, *rules.phonetic)] + list(extra)
    return tuple(dict.fromkeys(w for w in words if w and len(w) >= 2))


def keyword_scan(df: DataFrame, keywords: Sequence[str], text: str = "text") -> DataFrame:
    """One row per (row, keyword) where the text contains the keyword."""
    found = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.col(text).contains(k))
    return df.withColumn("keyword", F.explode(found))


def character_scan(df: DataFrame, characters: str, text: str = "text", out: str = "found") -> DataFrame:
    """Rows with any of the characters, and every occurrence in order."""
    from cueline.functions.text import char_class

    cls = char_class(characters)
    return df.where(F.col(text).rlike(cls)).withColumn(out, F.regexp_extract_all(text, F.lit(cls), F.lit(0)))
