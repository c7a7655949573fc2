import json

from conftest import segments_of
from pyspark.sql import functions as F

from cueline.operators import experiments
from cueline.sources import readers, writers
from cueline.streaming import feeds


def test_srt_file(spark, tmp_path):
    (tmp_path / "a.srt").write_text(
        "1\n00:00:00,000 --> 00:00:02,000\n你好\n世界\n\n\nx\nbroken\n\n2\n00:00:02,500 --> bad\n坏\n\n3\n00:00:03,000 --> 00:00:04,250\n完\n", encoding="utf-8"
    )
    rows = readers.read_srt(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r.file_id, r["index"], r.start_ms, r.end_ms, r.text) for r in rows] == [
        ("a", 1, 0, 2000, "你好\n世界"), ("a", 3, 3000, 4250, "完"),
    ]


def test_ass_file(spark, tmp_path):
    lines = [
        "[Script Info]", "Dialogue: 0,0:00:00.00,0:00:01.00,D,,0,0,0,,outside", "[Events]", "Format: x",
        "Dialogue: 0,0:00:01.00,0:00:02.50,D,,0,0,0,,{\\p1}你好, 世界", "Dialogue: 0,0:00:01.00,0:00:02.00,D,,0,0,0,,m 0 0 l 1 1",
        "Dialogue: 0,0:00:02.00,0:00:03.00,D,,0,0,0,,{\\b1}", "Dialogue: 0,0:00:02.00,0:00:03.00,D,,0,0,0,,7 days", "Comment: x",
        "Dialogue: 0,0:00:03.00,0:00:04.00,D,,0,0,0,,完", "[Fonts]", "Dialogue: 0,0:00:05.00,0:00:06.00,D,,0,0,0,,after",
    ]
    (tmp_path / "b.ass").write_text("\n".join(lines), encoding="utf-8")
    rows = readers.read_ass(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["index"], r.start_ms, r.end_ms, r.text) for r in rows] == [(1, 1000, 2500, "你好, 世界"), (2, 3000, 4000, "完")]


def test_transcript_json(spark, tmp_path):
    (tmp_path / "object.json").write_text(json.dumps({
        "duration": 9.5,
        "segments": [
            {"start": 0.11, "end": 1.282, "text": " 从 "}, {"begin": 2, "end": 3, "sentence": "这个"},
            {"start": "4", "end": 5, "text": "坏"}, {"start": 6, "end": 7, "text": ""}, {"end": 8, "text": "零"},
        ],
    }), encoding="utf-8")
    (tmp_path / "array.json").write_text(json.dumps([
        {"start": 1.5, "end": 250000, "text": "甲"}, {"begin": 99999, "end": 100000, "sentence": None}, {"start": None, "end": 1, "text": "坏"},
    ]), encoding="utf-8")
    rows = readers.read_transcripts(spark, str(tmp_path)).orderBy("transcript_id", "seg_idx").collect()
    assert [(r.transcript_id, r.seg_idx, r.start_ms, r.end_ms, r.text) for r in rows] == [
        ("array", 0, 1500, 250000, "甲"), ("array", 1, 99999000, 100000, ""),
        ("object", 0, 110, 1282, "从"), ("object", 1, 2000, 3000, "这个"), ("object", 2, 0, 8000, "零"),
    ]
    assert {r.duration_s for r in rows if r.transcript_id == "object"} == {9.5}


def test_canonical_round_trip(spark, tmp_path):
    rows = segments_of(spark, [(i * 10, i * 10 + 5, f"s{i}") for i in range(7)])
    writers.write_canonical(rows, str(tmp_path / "c"), part_rows=3)
    back = readers.read_canonical(spark, str(tmp_path / "c")).orderBy("seg_idx").collect()
    assert [(r.seg_idx, r.start_ms, r.text, r.language, r.confidence) for r in back] == [(i, i * 10, f"s{i}", "zh", 1.0) for i in range(7)]


def test_rules_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"authors": {"甲": "乙"}, "asr_noise": {"嗯": ""}, "notes": {"a": "b"}}), encoding="utf-8")
    got = {(r.category, r.wrong, r.correct) for r in readers.read_rules(spark, str(tmp_path / "r.json")).collect()}
    assert got == {("authors", "甲", "乙"), ("asr_noise", "嗯", "")}
    (tmp_path / "c.json").write_text(json.dumps({"corrections": {"一": "二"}}), encoding="utf-8")
    assert [tuple(r)[2:] for r in readers.read_corrections(spark, str(tmp_path / "c.json")).collect()] == [("一", "二")]
    (tmp_path / "m.json").write_text(json.dumps({"書": "书"}), encoding="utf-8")
    assert [tuple(r) for r in readers.read_char_map(spark, str(tmp_path / "m.json")).collect()] == [("書", "书")]


def test_clip_file(spark, tmp_path):
    (tmp_path / "clips.json").write_text(json.dumps({"deep": [{"id": "x", "title": "T", "start_s": 0.0, "end_s": 60.0, "hook": "h"}]}), encoding="utf-8")
    row = readers.read_clips(spark, str(tmp_path / "clips.json")).first()
    assert (row.series, row.clip_id, row.start_ms, row.end_ms, row.hook, row.domain) == ("deep", "x", 0, 60000, "h", None)


def test_metadata_leaves_out_missing_fields(spark):
    clip = spark.createDataFrame([("t", "c", "deep", 0, 60000, None)], "transcript_id string, clip_id string, series string, start_ms bigint, end_ms bigint, domain string")
    entries = spark.createDataFrame([("t", "c")] * 2, "transcript_id string, clip_id string")
    row = json.loads(writers.clip_metadata(clip, entries, ["transcript_id", "clip_id"], {"project": F.lit("p")}).first().metadata)
    assert row["duration_s"] == 60.0 and row["subtitle_count"] == 2 and row["project"] == "p" and "domain" not in row


def test_log(spark, tmp_path):
    path = tmp_path / "log"
    rows = spark.createDataFrame([(f"2024-01-0{i}", "INFO" if i < 3 else "ERROR", "c", "m", None) for i in range(1, 5)], readers.LOG)
    writers.append_log(rows, str(path))
    (path / "broken.json").write_text("{not json\n")
    log = readers.read_log(spark, str(path))
    assert {(r.level, r.n) for r in experiments.log_levels(log).collect()} == {("INFO", 2), ("ERROR", 2), (None, 4)}
    assert [r.timestamp for r in experiments.latest_log(log, 2).collect()] == ["2024-01-04", "2024-01-03"]


def test_summaries(spark, tmp_path):
    for i, data in enumerate(({"generated": 3, "skipped": 1}, {"generated_count": 2, "skipped_count": 0, "total_time_s": 1.5})):
        (tmp_path / f"s{i}").mkdir()
        (tmp_path / f"s{i}" / "summary.json").write_text(json.dumps(data))
    (tmp_path / "other.json").write_text("{}")
    rows = readers.read_summaries(spark, str(tmp_path)).collect()
    assert sorted((r.generated, r.skipped) for r in rows) == [(2, 0), (3, 1)]


def test_pending(spark):
    clips = spark.createDataFrame([("t", "a"), ("t", "b")], "transcript_id string, clip_id string")
    done = clips.where("clip_id = 'a'")
    assert [r.clip_id for r in writers.pending_clips(clips, done, ["transcript_id", "clip_id"]).collect()] == ["b"]


def test_log_feed(spark, tmp_path):
    log, counts, state = tmp_path / "log", str(tmp_path / "counts"), str(tmp_path / "state")
    row = lambda level: spark.createDataFrame([("2024-01-01", level, "c", "m", None)], readers.LOG)
    writers.append_log(row("INFO"), str(log))
    feeds.count_new_log_lines(spark, str(log), counts, state)
    writers.append_log(row("ERROR"), str(log))
    feeds.count_new_log_lines(spark, str(log), counts, state)
    total = spark.read.parquet(counts).groupBy("level").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in total.collect()} == {("INFO", 1), ("ERROR", 1)}


def test_srt_line_ends(spark, tmp_path):
    cue = "1{e}00:00:00,000 --> 00:00:01,000{e}a{e}b{e}{e}{e}2{e}00:00:02,000 --> 00:00:03,500{e}c{e}{e}x{e}"
    (tmp_path / "lf.srt").write_bytes(cue.format(e="\n").encode())
    (tmp_path / "crlf.srt").write_bytes(cue.format(e="\r\n").encode())
    (tmp_path / "mixed.srt").write_bytes((cue.format(e="\n").replace("a\n", "a\r\n")).encode())
    rows = readers.read_srt(spark, str(tmp_path)).orderBy("file_id", "index").collect()
    assert [(r.file_id, r["index"], r.start_ms, r.end_ms, r.text) for r in rows] == [
        (f, i, s, e, t) for f in ("crlf", "lf", "mixed") for i, s, e, t in ((1, 0, 1000, "a\nb"), (2, 2000, 3500, "c"))
    ]


def test_transcript_beyond_the_size_of_a_variant(spark, tmp_path):
    item = '{"start": %d.5, "end": %d, "text": "' + "x" * 70_000 + '"}'
    with open(tmp_path / "big.json", "w") as out:
        out.write('{"duration": 3, "segments": [' + ",".join(item % (i, i + 1) for i in range(2_100)) + "]}")
    (tmp_path / "broken.json").write_text('{"segments": [')
    rows = readers.read_transcripts(spark, str(tmp_path))
    assert rows.selectExpr("count(*) n", "max(seg_idx) last", "max(start_ms) start", "max(duration_s) d").first()[:] == (2_100, 2_099, 2_099_500, 3.0)


def test_listings_of_negative_times(spark):
    rows = segments_of(spark, [(-200, 900, "a"), (-1500, -1400, "b"), (2500, 2600, "c")]).withColumn("index", F.col("seg_idx") + 1).orderBy("index")
    assert [r.v for r in rows.select(writers.listing().alias("v")).collect()] == ["[   1] (    -0s) a", "[   2] (    -2s) b", "[   3] (     2s) c"]
    topic = spark.createDataFrame([("t", "of", -200, 34000), ("u", "of", 40, -420)], "topic_id string, title string, start_ms bigint, end_ms bigint")
    assert [r.v for r in topic.select(writers.topic_listing().alias("v")).collect()] == ["t: of (-0s-34s, 0.6min)", "u: of (0s--0s, -0.0min)"]


def test_document_in_part_files(spark, tmp_path):
    """A document cut into part files keeps the entries of its later parts and their numbers."""
    rows = segments_of(spark, [(i * 1000 - 200, i * 1000 + 500, f"line {i}") for i in range(40)]).withColumn("index", F.col("seg_idx") + 1)
    rows = rows.withColumn("transcript_id", F.lit(7))
    for name, lines, read in [
        ("ass", writers.ass_lines(rows, ["transcript_id"], F.lit("t")), readers.read_ass), ("srt", writers.srt_cues(rows, ["transcript_id"]), readers.read_srt),
    ]:
        path = str(tmp_path / name)
        lines.repartitionByRange(4, "line_no").sortWithinPartitions("line_no").select("transcript_id", "value").write.partitionBy("transcript_id").text(path)
        back = read(spark, path, suffix="txt", folders=True).orderBy("start_ms").collect()
        assert [(r["index"], r.start_ms, r.end_ms, r.text) for r in back] == [(i + 1, i * 1000 - 200, i * 1000 + 500, f"line {i}") for i in range(40)]
        assert {r.file_id for r in back} == {"transcript_id=7"}


def test_many_documents_in_few_files(spark, tmp_path):
    """Neither packed transcripts nor reports take a file per document."""
    from pathlib import Path

    docs = spark.range(300).coalesce(2).withColumn("value", F.format_string('[{"start":1,"end":2,"text":"a b %d"}]', "id"))
    writers.write_packed(docs, str(tmp_path / "t"), F.format_string("folder/%d.json", "id"))
    rows = readers.read_transcripts(spark, str(tmp_path / "t"), packed=True).collect()
    assert {(r.transcript_id, r.seg_idx, r.start_ms, r.text, r.source_file) for r in rows} == {(str(i), 0, 1000, f"a b {i}", f"folder/{i}.json") for i in range(300)}
    reports = spark.range(300).coalesce(2).select(F.col("id").cast("string").alias("version_key"), F.lit(80.0).alias("overall_score"))
    writers.write_reports(reports, str(tmp_path / "r"))
    assert {r.version_key for r in readers.read_reports(spark, str(tmp_path / "r")).collect()} == {str(i) for i in range(300)}
    assert len(list(Path(tmp_path).glob("*/**/part-*"))) == 4
