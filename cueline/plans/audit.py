"""Audits: the checks and scores of a corpus composed into reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.operators import checks, scoring
from cueline.operators.rules import Rules
from cueline.params import PUBLISHING, SubtitleParams


def all_issues(
    entries: DataFrame, segments: DataFrame, keys: Sequence[str], params: SubtitleParams, standard: SubtitleParams = PUBLISHING, rules: Rules = Rules()
) -> DataFrame:
    """The long issues table of timing, content and alignment.

    ``entries`` come from ``with_entry_context``, ``segments`` from ``with_previous``.
    """
    timing = checks.issues(entries, keys, F.col("seg_idx"), checks.timing_family(params, rules), source="timing")
    content = checks.issues(entries, keys, F.col("seg_idx"), checks.content_family(params, rules), source="content")
    aligned = checks.issues(segments, keys, F.col("pos"), checks.alignment_family(params, standard), source="alignment")
    return timing.unionByName(content).unionByName(aligned)


def single_iteration(
    entries: DataFrame, segments: DataFrame, keys: Sequence[str], params: SubtitleParams, standard: SubtitleParams = PUBLISHING, rules: Rules = Rules()
) -> DataFrame:
    """Content, timing and alignment scores of each transcript, combined."""
    timing, content = (make(params, rules, places=False) for make in (checks.timing_family, checks.content_family))
    scores = scoring.entry_scores(entries, keys, timing, content)
    aligned = scoring.alignment_report(segments, keys, checks.alignment_family(params, standard), params)
    return scoring.combined_iteration(scores, aligned, keys)
