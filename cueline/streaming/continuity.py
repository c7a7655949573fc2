"""Gaps between consecutive segments of transcripts whose documents keep arriving.

A canonical transcript is written in documents (``part`` 0, 1, …), which may arrive in
any order and in any batch. Gaps inside a document need no state. Only the edge
between two documents does: what is kept per transcript is the end of every part whose
successor is missing, and the start of every part whose predecessor is missing; when
both sides of an edge are there, its gap is emitted and both are forgotten. A
transcript with millions of segments is thus a few numbers of state, and its stateful task
sees one short row per document.

A transcript that gets nothing for ``closed_after_s`` is closed: its open edges are dropped
by a timeout. Documents of a transcript follow each other in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueline.operators import checks
from cueline.sources.readers import CANONICAL

GAPS = "transcript_id string, seg_idx bigint, prev_end_ms bigint, start_ms bigint, gap_ms bigint"
STATE = "ended array<bigint>, ends array<bigint>, started array<bigint>, indices array<bigint>, starts array<bigint>"


def _edges(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The stateful step of one transcript: sides of new documents in, gaps of completed edges out."""
    ended, ends, started, indices, starts = state.get if state.exists else ([], [], [], [], [])
    open_ends, open_starts, found = dict(zip(ended, ends)), dict(zip(started, zip(indices, starts))), []
    for frame in rows:
        for part, seg_idx, start, end, last in zip(*(frame[c].tolist() for c in ("part", "seg_idx", "start_ms", "end_ms", "is_last"))):
            if part - 1 in open_ends:
                found.append((key[0], seg_idx, open_ends.pop(part - 1), start))
            elif part > 0:
                open_starts[part] = seg_idx, start
            if part + 1 in open_starts:
                later, later_start = open_starts.pop(part + 1)
                found.append((key[0], later, end, later_start))
            elif not last:
                open_ends[part] = end
    if open_ends or open_starts:
        state.update((list(open_ends), list(open_ends.values()), list(open_starts), [i for i, _ in open_starts.values()], [t for _, t in open_starts.values()]))
    elif state.exists:
        state.remove()
    gaps = pd.DataFrame(found, columns=["transcript_id", "seg_idx", "prev_end_ms", "start_ms"])
    yield gaps.assign(gap_ms=gaps["start_ms"] - gaps["prev_end_ms"])


def gaps_of_documents(docs: DataFrame) -> DataFrame:
    """Gaps between all consecutive segments of a stream of canonical documents."""
    in_time = F.array_sort("segments", lambda a, b: F.when((a["start_ms"] < b["start_ms"]) | ((a["start_ms"] == b["start_ms"]) & (a["seg_idx"] < b["seg_idx"])), -1).otherwise(1))
    rows = docs.where(F.size("segments") > 0).select("transcript_id", "part", "segment_count", in_time.alias("s"))

    def gap(i):
        this, before = F.get("s", i), F.get("s", i - 1)
        return F.struct(this["seg_idx"].alias("seg_idx"), before["end_ms"].alias("prev_end_ms"), this["start_ms"].alias("start_ms"), (this["start_ms"] - before["end_ms"]).alias("gap_ms"))

    inside = rows.where(F.size("s") > 1).select("transcript_id", F.inline(F.transform(F.sequence(F.lit(1), F.size("s") - 1), gap)))
    last = F.coalesce(F.array_max(F.transform("s", lambda x: x["seg_idx"])) + 1 >= F.col("segment_count"), F.lit(False))
    sides = rows.select("transcript_id", "part", F.get("s", F.lit(0))["seg_idx"].alias("seg_idx"), F.get("s", F.lit(0))["start_ms"].alias("start_ms"), F.element_at("s", -1)["end_ms"].alias("end_ms"), last.alias("is_last"))
    edges = sides.groupBy("transcript_id").applyInPandasWithState(_edges, GAPS, STATE, "append", GroupStateTimeout.NoTimeout)
    return inside.unionByName(edges)


def append_gaps(spark: SparkSession, path: str, out: str, state: str) -> None:
    """Append the gaps of documents that arrived in ``path`` since the last run to the table ``out``.

    ``state`` is the query's checkpoint folder. A second run over the same documents does no work.
    """
    docs = spark.readStream.schema(CANONICAL).json(path)
    gaps = gaps_of_documents(docs)
    query = gaps.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def issues_of(gaps: DataFrame) -> DataFrame:
    """Overlaps, large and moderate gaps."""
    return gaps.select("transcript_id", "seg_idx", F.inline(checks.continuity()))


def silences_of(gaps: DataFrame, min_silence_s: float = 1.5) -> DataFrame:
    """Gaps long enough to be a silence, as :func:`cueline.operators.timeline.silences` gives them."""
    return gaps.where(F.col("gap_ms") >= min_silence_s * 1000).select(
        "transcript_id", F.col("prev_end_ms").alias("start_ms"), F.col("start_ms").alias("end_ms"), F.col("gap_ms").alias("duration_ms"),
        (F.col("prev_end_ms") / 1000).alias("position_s"),
    )
