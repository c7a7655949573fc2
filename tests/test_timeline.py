import pytest
from conftest import segments_of
from pyspark.sql import functions as F

from cueline.operators import timeline
from cueline.params import SubtitleParams

KEY = ["transcript_id"]
ROWS = [(1000, 3000, "你好"), (3000, 5000, "世界"), (5000, 7000, "测试")]


def clips(spark, *bounds):
    return spark.createDataFrame([("t", f"c{i}", a, b) for i, (a, b) in enumerate(bounds)], "transcript_id string, clip_id string, start_ms bigint, end_ms bigint")


def extracted(spark, rows, a, b, **options):
    got = timeline.extract_clip_entries(segments_of(spark, rows), clips(spark, (a, b)), **options)
    return [(r.start_ms, r.end_ms, r.text) for r in got.orderBy("seg_idx").collect()]


def test_clip_extraction(spark):
    assert extracted(spark, ROWS, 1000, 5000) == [(0, 2000, "你好"), (2000, 4000, "世界")]
    assert extracted(spark, ROWS, 20000, 30000) == []
    assert extracted(spark, [(3000, 7000, "跨越边界")], 4000, 8000) == [(0, 3000, "跨越边界")]
    assert extracted(spark, [(0, 4400, "太短")], 4000, 8000) == []


def test_long_intervals_meet_once(spark):
    """Both sides span many buckets; the pair must come out once."""
    assert extracted(spark, [(0, 600_000, "长")], 30_000, 500_000) == [(0, 470_000, "长")]


def test_slices_keep_short_and_empty_entries(spark):
    rows = segments_of(spark, [(5000, 5000, "点"), (5000, 5200, "短"), (9000, 9900, "后")])
    got = timeline.slice_clip_subtitles(rows, clips(spark, (5000, 9500))).orderBy("index").collect()
    assert [(r["index"], r.start_ms, r.end_ms, r.text) for r in got] == [(1, 0, 1000, "点"), (2, 1067, 1000, "短"), (3, 4000, 5000, "后")]


def test_silences_and_neighbours(spark):
    rows = segments_of(spark, [(0, 1000, "a"), (2500, 3000, "b"), (3100, 4000, "c")])
    assert [tuple(r) for r in timeline.silences(rows, KEY).collect()] == [("t", 1000, 2500, 1500, 1.0)]
    ahead = timeline.with_next(rows, KEY).orderBy("pos").collect()
    assert [(r.next_text, r.next_gap_ms, r.is_last) for r in ahead] == [("b", 1500, False), ("c", 100, False), ("", 0, True)]
    context = timeline.with_context(rows, KEY, width=1, size=2).orderBy("seg_idx").collect()
    assert [r.context for r in context] == ["a b", "a b c", "b c"]


def test_gaps_and_readability(spark):
    rows = segments_of(spark, [(0, 2000, "一二三"), (2010, 2500, "四五六七八九十"), (4000, 5000, "")])
    gaps = timeline.insert_gaps(rows, KEY).orderBy("pos").collect()
    assert [r.end_ms for r in gaps] == [1967, 2500, 5000]
    longer = timeline.extend_for_readability(rows, KEY).orderBy("pos").collect()
    assert [r.end_ms for r in longer] == [2000, 3176, 5000]


@pytest.mark.parametrize("target,wanted", [(5.0, 4.6), (5.3, 5.9), (9.0, None), (0.5, 0.0)])
def test_nearest_silence(spark, target, wanted):
    targets = spark.createDataFrame([("f", target)], "f string, target_s double")
    points = spark.createDataFrame([("f", t) for t in (0.0, 4.6, 5.9, 10.1)], "f string, t_s double")
    assert timeline.snap_to_silence(targets, points, ["f"]).first().silence_s == wanted


def test_cuts_are_padded_without_silence(spark):
    cut = spark.createDataFrame([("f", "c", 50, 2000)], "f string, clip_id string, start_ms bigint, end_ms bigint")
    none = spark.createDataFrame([], "f string, t_s double")
    row = timeline.optimise_cuts(cut, none, ["f"]).first()
    assert (row.cut_start_s, row.cut_end_s) == (0.0, 2.1)


def test_unknown_parameter():
    with pytest.raises(KeyError):
        SubtitleParams().with_values(nothing=1)
