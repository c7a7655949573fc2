"""Feeds: documents that arrive in batches give what one batch job gives."""

import json

import pytest
from pyspark.sql import functions as F

from cueline.operators import checks, timeline
from cueline.streaming import continuity, feeds

KEY = ["transcript_id"]


def document(transcript, part, rows):
    segments = [{"seg_idx": i, "start_ms": s, "end_ms": e, "text": "x"} for i, s, e in rows]
    return {"transcript_id": transcript, "part": part, "segment_count": {"a": 9, "b": 5}[transcript], "segments": segments}


def documents():
    """Three documents of one transcript, two of another, with overlaps and silences at the edges and inside."""
    docs, at = [], 0
    for transcript, sizes in (("a", (3, 2, 4)), ("b", (2, 3))):
        number = 0
        for part, size in enumerate(sizes):
            rows = []
            for _ in range(size):
                start = at + (number * 1_700) % 4_001 - 300
                rows.append((number, start, start + 900))
                at, number = start + 900, number + 1
            docs.append(document(transcript, part, rows))
    return docs


@pytest.mark.parametrize("batches", [[[0, 1, 2, 3, 4]], [[0, 3], [1], [2, 4]], [[2, 4], [0], [1, 3]]])
def test_batches_give_the_gaps_of_one(spark, tmp_path, batches):
    docs, folder = documents(), tmp_path / "in"
    folder.mkdir()
    for number, batch in enumerate(batches):
        (folder / f"{number}.json").write_text("\n".join(json.dumps(docs[i]) for i in batch))
        continuity.append_gaps(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))
    continuity.append_gaps(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))  # nothing new
    gaps = spark.read.parquet(str(tmp_path / "out"))
    rows = [(d["transcript_id"], s["seg_idx"], s["start_ms"], s["end_ms"], "x") for d in docs for s in d["segments"]]
    whole = timeline.with_time_order(spark.createDataFrame(rows, "transcript_id string, seg_idx bigint, start_ms bigint, end_ms bigint, text string"), KEY)
    want = timeline.with_previous(whole, KEY).select("transcript_id", "seg_idx", F.inline(checks.continuity()))
    assert sorted(map(tuple, continuity.issues_of(gaps).collect())) == sorted(map(tuple, want.collect()))
    silent = timeline.silences(whole, KEY)
    assert sorted(map(tuple, continuity.silences_of(gaps).select(*silent.columns).collect())) == sorted(map(tuple, silent.collect()))


def test_new_transcripts_are_handed_over_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    docs = documents()
    for number in (0, 1):
        (folder / f"{number}.json").write_text(json.dumps(docs[number]))
        feeds.new_transcripts(spark, str(folder), lambda batch, _: seen.append(batch.count()), str(tmp_path / "state"))
    assert [n for n in seen if n] == [3, 2]
