"""Ordered primitives give the same result whatever the block size."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.operators import ordered

cloudpickle.register_pickle_by_value(sys.modules[__name__])

@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows, a third of them in one key, many at the same instant."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = 0 if i % 3 == 0 else rng.randint(1, 12)
        at = 5000 if i % 4 == 0 else rng.randint(0, 100_000)
        rows.append((key, i, at, rng.randint(-5, 20)))
    return spark.createDataFrame(rows, "k int, tie bigint, at bigint, v bigint").cache()


def expected(df, column, out):
    return {(r.k, r.tie): r[out] for r in df.withColumn(out, column).collect()}


def actual(df, out):
    return {(r.k, r.tie): r[out] for r in df.collect()}


@pytest.mark.parametrize("heavy", [3, 20, 10**6])
def test_time_position(skewed, heavy):
    w = Window.partitionBy("k").orderBy("at", "tie")
    want = expected(skewed, F.row_number().over(w) - 1, "pos")
    got = ordered.time_position(skewed, ["k"], "at", "tie", total="n", bucket=2000, heavy_rows=heavy)
    assert actual(got, "pos") == want
    sizes = {r.k: r["count"] for r in skewed.groupBy("k").count().collect()}
    assert all(r.n == sizes[r.k] for r in got.collect())


@pytest.fixture(scope="module")
def placed(skewed):
    return ordered.time_position(skewed, ["k"], "at", "tie", total="n").cache()


@pytest.mark.parametrize("size", [3, 7, 50_000])
def test_over_neighbours(placed, size):
    w = Window.partitionBy("k").orderBy("pos")
    want = expected(placed, F.concat_ws(",", F.lag("v", 3).over(w), F.lag("v").over(w), F.lead("v", 2).over(w)), "x")
    got = ordered.over_neighbours(
        placed, ["k"], "pos",
        {"a": lambda w: F.lag("v", 3).over(w), "b": lambda w: F.lag("v").over(w), "c": lambda w: F.lead("v", 2).over(w)},
        before=3, after=2, size=size,
    ).withColumn("x", F.concat_ws(",", "a", "b", "c"))
    assert actual(got, "x") == want


@pytest.mark.parametrize("size", [3, 50_000])
def test_running(placed, size):
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    assert actual(ordered.running_total(placed, ["k"], "pos", {"x": "v"}, size), "x") == expected(
        placed, F.coalesce(F.sum("v").over(w), F.lit(0)), "x"
    )
    assert actual(ordered.running_max(placed, ["k"], "pos", {"x": "v"}, False, size), "x") == expected(placed, F.max("v").over(w), "x")


def test_blocks_are_bounded(placed):
    rows = ordered.with_halo(placed, "pos", 2, 2, 10).groupBy("k", "_block").count()
    assert rows.agg(F.max("count")).first()[0] <= 14


class Reset(ordered.Fold):
    """Running sum that starts anew above 30."""

    def __init__(self):
        self.total = 0

    def push(self, row):
        self.total = row["v"] if self.total > 30 else self.total + row["v"]
        return [(row["pos"], self.total)]

    def state(self):
        return (self.total,)


class Forever(Reset):
    """A sum that never forgets: no warm-up is long enough short of everything."""

    def push(self, row):
        self.total += row["v"]
        return [(row["pos"], self.total)]


@pytest.mark.parametrize("fold", [Reset, Forever])
@pytest.mark.parametrize("size,warmup", [(5, 2), (16, 40), (50_000, 2000)])
def test_ordered_fold_equals_one_run(placed, fold, size, warmup):
    fields = [T.StructField("pos", T.LongType()), T.StructField("total", T.LongType())]
    got = ordered.ordered_fold(placed, ["k"], "pos", "n", lambda key: fold(), fields, size=size, warmup=warmup)
    want = set()
    for k in {r.k for r in placed.select("k").distinct().collect()}:
        machine = fold()
        for r in placed.where(F.col("k") == k).orderBy("pos").collect():
            want |= {(k, *out) for out in machine.push(r.asDict())}
    assert {tuple(r) for r in got.drop("_block", "_seq").collect()} == want


def test_time_position_shuffles_rows_once(skewed, capsys):
    """Without heavy buckets the rows are not joined with a table of them."""
    ordered.time_position(skewed, ["k"], "at", "tie", total="n", bucket=2000).explain()
    plan = capsys.readouterr().out
    assert "_b0" in plan and "_heavy" not in plan and "_b1" not in plan
