"""Cuts by collected length against one sequential run."""

import random

import numpy as np
import pytest

from cueline.operators import cuts


def one_run(rows, low, high):
    """Run number and start of every (length, marked) row, in one pass."""
    have, found = None, []
    for i, (length, marked) in enumerate(rows):
        opens = have is None or (have >= low and (have >= high or marked))
        have = length if opens else have + length
        found.append((found[-1][0] + 1, i) if found and opens else (1, i) if opens else found[-1])
    return found


def some_rows(kind, n, seed):
    pick = random.Random(seed)
    least = -300 if kind == "negative" else 0
    return [(pick.choice((0, pick.randint(least, 900))), kind != "no silences" and pick.random() < 0.2) for _ in range(n)]


@pytest.mark.parametrize("kind", ["silences", "no silences", "negative"])
def test_composed_tables_equal_one_run(kind):
    for seed in range(60):
        rows, pick = some_rows(kind, 60, seed), random.Random(seed)
        least = sum(min(length, 0) for length, _ in rows)
        edges = sorted({0, 60, *(pick.randint(1, 59) for _ in range(5))})
        low, high = pick.choice([(500, 2000), (0, 0), (3000, 1000), (1, 100_000)])
        want, state, whole = one_run(rows, low, high), cuts.State(1 << 62, 0, -1), None
        for first, last in zip(edges, edges[1:]):
            block = cuts.Block(np.array([r[0] for r in rows[first:last]]), np.array([r[1] for r in rows[first:last]]), first, low, high)
            numbers, starts = block.mark(state)
            assert list(zip(numbers.tolist(), starts.tolist())) == want[first:last]
            table = block.table(least)
            state, whole = table.apply(state), table if whole is None else cuts.compose(whole, table, least)
            assert whole.apply(cuts.State(1 << 62, 0, -1)) == state


def test_tables_do_not_grow_with_the_rows():
    lengths = np.full(40_000, 100)
    table = cuts.Block(lengths, np.zeros(40_000, bool), 0, 1000, 3000).table(0)
    assert len(table.thresholds) <= 31
    assert len(cuts.compose(table, table, 0).thresholds) <= 31


@pytest.mark.parametrize("kind", ["silences", "no silences", "negative"])
def test_forty_blocks_in_a_tree(spark, kind):
    rows, other = some_rows(kind, 400, 1), some_rows(kind, 7, 2)
    data = [("t", i, *r, "x") for i, r in enumerate(rows)] + [("u", i, *r, None) for i, r in enumerate(other)]
    df = spark.createDataFrame(data, "k string, pos bigint, length bigint, marked boolean, text string").repartition(5)
    got = cuts.cut_runs(df, ["k"], "pos", "length", "marked", 1000, 2500.0, "no", "start", size=10, fan_out=3).collect()
    found = {(r.k, r.pos): (r.no, r.start) for r in got}
    assert found == {("t", i): w for i, w in enumerate(one_run(rows, 1000, 2500))} | {("u", i): w for i, w in enumerate(one_run(other, 1000, 2500))}
    assert {r.text for r in got if r.k == "t"} == {"x"}


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, pos bigint, length bigint, marked boolean")
    assert cuts.cut_runs(df, ["k"], "pos", "length", "marked", 1, 2, "no", "start").count() == 0
