"""Merge steps on literal rows, and independence of the block size."""

import pytest
from conftest import segments_of
from pyspark.sql import functions as F

from cueline.operators import merging
from cueline.params import LATIN, SubtitleParams

P = SubtitleParams(max_chars=18, max_lines=2)
LIMITS = merging.Limits(P)
NARROW = SubtitleParams(max_chars=5, max_lines=1)
#: Invented speech: short and long stretches, a long pause, quick words, and openings of fragments.
SCENARIO = [
    (200, 900, "早上"), (900, 1400, "好啊"), (1450, 4300, "今天我们先看看地图再出发"), (4300, 4600, "然后"),
    (4650, 7200, "沿着河边慢慢走到桥头"), (7200, 7500, "但"), (7550, 8900, "是要小心台阶"), (8900, 11800, "桥那头有一家旧书店"),
    (14200, 16900, "老板养了两只猫"), (16900, 17300, "一黑一白"), (17350, 19800, "它们整天睡在柜台上"), (19800, 22600, "谁来了也不抬头看一眼"),
    (22650, 23000, "对"), (23000, 26100, "可是一听见下雨就跑到窗边"), (26100, 28900, "坐着看到雨停为止"),
]


def run(steps, rows, params=P):
    """The chain without Spark: the same object the workers use."""
    chain = merging.SegmentChain(steps, params)
    out = []
    for i, (s, e, t) in enumerate(rows):
        out += chain.push({"pos": i, "start_ms": s, "end_ms": e, "text": t})
    return out + chain.flush()


def texts(rows):
    return [r[2] for r in rows]


@pytest.mark.parametrize(
    "start,end,text,wanted",
    [
        (0, 1500, "好的", True), (0, 700, "傍晚一起去湖边散步", True), (0, 3000, "傍晚一起去湖边散步", False), (500, 1499, "山高水长", True),
        (500, 1500, "山高水长", False), (0, 4000, "风", True), (0, 1800, "但愿人长久", True), (0, 1800, "但愿人长久啊", False),
    ],
)
def test_fragments(spark, start, end, text, wanted):
    """Three characters at most, under the least time, or five at most behind a fragment's opening."""
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(merging.is_fragment(F.col("text"), F.lit(end - start), P)).first()[0] is wanted
    assert merging.JoinFragments(LIMITS).needs_care(LIMITS.seg(start, end, text, (0,))) is wanted


@pytest.mark.parametrize(
    "a,b,params,wanted",
    [
        ((100, 1900, "桥头"), (1950, 4000, "有一家书店"), P, True),
        ((0, 2000, "猫睡着了"), (2000, 4000, "雨停了"), SubtitleParams(max_chars=3, max_lines=2), False),  # seven of six characters
        ((0, 4000, "慢慢"), (4000, 7001, "走"), P, False),  # over seven seconds
        ((0, 4000, "慢慢"), (4000, 7000, "走"), P, True),
        ((0, 300, "沿着河边走"), (300, 600, "不要停下来"), P, False),  # too fast together
    ],
)
def test_pairs(spark, a, b, params, wanted):
    limits = merging.Limits(params)
    assert limits.pair_fits(limits.seg(*a, (0,)), limits.seg(*b, (1,))) is wanted
    lit = [F.lit(x) for x in (a[2], a[0], b[2], b[1])]
    assert spark.range(1).select(merging.pair_fits(*lit, params)).first()[0] is wanted


def test_join_fragments():
    step = ["join_fragments"]
    assert texts(run(step, [(0, 2500, "老板养了两只猫")])) == ["老板养了两只猫"]
    # forward where the pair fits, else back, else alone
    assert texts(run(step, [(0, 400, "早上"), (400, 3000, "我们沿着河边走")])) == ["早上我们沿着河边走"]
    assert texts(run(step, [(0, 2600, "我们沿着河边走"), (2600, 3000, "真好")])) == ["我们沿着河边走真好"]
    assert texts(run(step, [(0, 300, "雨"), (300, 2500, "一直下到天亮")], NARROW)) == ["雨", "一直下到天亮"]
    left = run(step, SCENARIO)
    assert len(left) < len(SCENARIO)
    assert all(len(t) >= 4 or e - s >= 1000 for s, e, t, _ in left)


def test_lengthen_short():
    step = ["lengthen_short"]
    assert texts(run(step, [(0, 600, "早上"), (650, 3200, "我们沿着河边走")])) == ["早上我们沿着河边走"]  # forward
    assert texts(run(step, [(0, 2600, "我们沿着河边走"), (2650, 3100, "真好")])) == ["我们沿着河边走真好"]  # back
    # alone: up to the next start less the least gap of 67 ms
    assert run(step, [(0, 400, "雨"), (900, 3000, "一直下到天亮才停")], NARROW)[0][:2] == (0, 833)
    assert run(step, [(0, 700, "雨停了")])[0][1] == 1000
    assert run(step, []) == []


def test_text_is_kept_in_order():
    whole = "".join(t for _, _, t in SCENARIO)
    for steps in (["join_short"], ["lengthen_short"], ["join_fast"], ["join_fragments"], merging.FULL_CHAIN):
        assert "".join(texts(run(steps, SCENARIO))) == whole


OVERLAP = [(0, 9000, "一二三四，" * 8), (4000, 9500, "五六七八九十"), (9600, 12000, "甲乙丙丁戊")]


def test_start_order_is_restored(spark):
    params = SubtitleParams(max_chars=12)
    out = run(merging.FULL_CHAIN, OVERLAP, params)
    assert [r[0] for r in out] == sorted(r[0] for r in out)
    got = merging.run_steps(segments_of(spark, OVERLAP), ["transcript_id"], merging.FULL_CHAIN, params).orderBy("pos").collect()
    assert [(r.start_ms, r.end_ms, r.text, r.source_rows) for r in got] == out
    entries = merging.transcript_to_entries(segments_of(spark, OVERLAP), ["transcript_id"], params).orderBy("index").collect()
    assert [r.start_ms for r in entries] == sorted(r.start_ms for r in entries)


@pytest.mark.parametrize("size,warmup", [(4, 2), (5, 16), (50_000, 2000)])
def test_blocks_do_not_matter(spark, size, warmup):
    rows = segments_of(spark, SCENARIO * 1)
    got = merging.run_steps(rows, ["transcript_id"], merging.FULL_CHAIN, P, size=size, warmup=warmup).orderBy("pos").collect()
    assert [(r.start_ms, r.end_ms, r.text, r.source_rows) for r in got] == run(merging.FULL_CHAIN, SCENARIO)


def test_whole_chain(spark):
    rows = merging.transcript_to_entries(segments_of(spark, SCENARIO), ["transcript_id"], P).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(len(r.text) >= 4 or r.end_ms - r.start_ms >= 1000 for r in rows)
    assert all(a.end_ms <= b.start_ms for a, b in zip(rows, rows[1:]))


def clip(entries, max_chars=18):
    fold, out = merging.ClipEntries(max_chars, 1.0, 1.2), []
    for s, e, t in entries:
        out += fold.push({"start_s": s, "end_s": e, "text": t})
    return out + fold.flush()


def test_clip_entries():
    assert clip([(0.0, 0.5, "你"), (0.5, 1.0, "好")]) == [(0.0, 1.0, "你好")]
    assert clip([(0.0, 2.0, "前面"), (2.0, 2.4, "后")]) == [(0.0, 2.4, "前面后")]
    assert clip([(0.0, 3.0, "甲"), (2.5, 5.0, "乙")]) == [(0.0, 2.46, "甲"), (2.5, 5.0, "乙")]
    close = clip([(0.0, 3.0, "甲"), (0.5, 5.0, "乙")])
    assert close[0][1] == pytest.approx(0.23) and close[1][0] == pytest.approx(0.27)
    assert clip([(0.0, 0.4, "一二三"), (0.5, 3.0, "四五六")], 5) == [(0.0, pytest.approx(0.23), "一二三"), (pytest.approx(0.27), 3.0, "四五六")]
    assert clip([(0.0, 2.0, "")]) == [] == clip([])
    assert clip([(0.0, 0.5, "短")]) == [(0.0, 1.2, "短")]


def test_settings_side_by_side(spark):
    rows = segments_of(spark, SCENARIO)
    settings = {"wide": P, "narrow": NARROW}
    both = merging.run_settings(rows, ["transcript_id"], merging.FULL_CHAIN, settings, size=6, warmup=3)
    for name, params in settings.items():
        got = both.where(F.col("param_id") == name).orderBy("pos").collect()
        assert [(r.start_ms, r.end_ms, r.text, r.source_rows) for r in got] == run(merging.FULL_CHAIN, SCENARIO, params)


def test_settings_share_the_count_of_characters(monkeypatch):
    """A row's characters are counted once, not once per setting; results are those of the single chains."""
    settings = {"a": LATIN, "b": LATIN.with_values(max_chars=50), "c": LATIN.with_values(max_display_s=10.0)}
    rows = [{"pos": i, "start_ms": i * 400, "end_ms": i * 400 + 380, "text": w} for i, w in enumerate("some words. that may join, or not".split() * 9)]
    steps = ["join_short", "start_order", "join_fragments"]
    alone = {k: merging.SegmentChain(steps, p) for k, p in settings.items()}
    want = {k: [out for r in rows for out in c.push(r)] + c.flush() for k, c in alone.items()}
    counted, count = [], merging.Limits.count
    monkeypatch.setattr(merging.Limits, "count", lambda self, text: counted.append(text) or count(self, text))
    many = merging.ManyChains(steps, settings, "pos")
    got = [out for r in rows for out in many.push(r)]
    assert len(counted) == len(rows)
    got += many.flush()
    assert {k: [v for n, *v in got if n == k] for k in settings} == {k: [list(v) for v in w] for k, w in want.items()}


def many_rows(n=400):
    words = ["some", "words, that", "may join.", "", "  ", "or not!", "a" * 30, "La fin; e"]
    return [(i * 310, i * 310 + (i * 37) % 900 + (9000 if i % 150 == 149 else -40), words[(i * 7 + i // 9) % 8]) for i in range(n)]


@pytest.mark.parametrize("steps", [merging.FULL_CHAIN, ("join_short",), ("split_long", "lengthen_short"), ("start_order", "join_fast")])
def test_rows_at_once_give_what_single_rows_give(steps):
    """Settings that differ in the time on screen share a chain until something is too long (F2)."""
    short = LATIN.with_values(max_display_s=2.0)
    settings = {"long": LATIN.with_values(max_display_s=12.0), "short": short, "same": short, "base": LATIN, "slow": LATIN.with_values(reading_speed=5.0)}
    rows = many_rows()
    columns = dict(zip(("start_ms", "end_ms", "text"), map(list, zip(*rows)))) | {"pos": list(range(len(rows)))}
    many, got = merging.ManyChains(steps, settings, "pos"), []
    alone = {k: merging.SegmentChain(steps, p) for k, p in settings.items()}
    want = {k: [] for k in settings}
    assert sum(map(len, many.alike.values())) == 2
    for first, stop in ((0, 1), (1, 1), (1, 140), (140, 155), (155, 400)):
        got += many.push_many(columns, first, stop)
        for k, chain in alone.items():
            want[k] += [out for i in range(first, stop) for out in chain.push({c: v[i] for c, v in columns.items()})]
        assert many.state() == tuple(chain.state() for chain in alone.values())
    got += many.flush()
    assert {k: [tuple(v) for n, *v in got if n == k] for k in settings} == {k: want[k] + c.flush() for k, c in alone.items()}


def test_results_are_numbered_from_block_sizes(spark):
    """A fold counts the results of a block itself, so nothing with texts is sorted again to number them (F15, F17)."""
    rows = merging.run_steps(segments_of(spark, SCENARIO), ["transcript_id"], merging.FULL_CHAIN, P, size=4, warmup=2)
    assert "row_number" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.pos for r in rows.collect()) == list(range(rows.count()))
