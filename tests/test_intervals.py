"""The interval join against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from cueline.operators import timeline

YEAR = 365 * 86_400_000


@pytest.mark.parametrize("bucket_ms", [60_000, 7])
def test_join_equals_every_pair(spark, bucket_ms):
    pick = random.Random(6)

    def some(n, longest):
        rows = []
        for i in range(n):
            start = pick.randint(-5_000, 400_000)
            rows.append((pick.choice("ab"), i, start, start + pick.choice((0, pick.randint(-50, 50), pick.randint(0, 3_000), pick.randint(0, longest)))))
        return rows

    left, right = some(120, 900_000), some(60, 200_000)
    entries = spark.createDataFrame(left + [("a", 998, None, 5), ("a", 999, 5, None)], "k string, e int, start_ms bigint, end_ms bigint")
    clips = spark.createDataFrame(right + [("a", 999, None, None)], "k string, c int, clip_start_ms bigint, clip_end_ms bigint")
    overlap = (F.col("start_ms") < F.col("clip_end_ms")) & (F.col("end_ms") > F.col("clip_start_ms"))
    got = [(r.e, r.c) for r in timeline.interval_join(entries, clips, "k", overlap, bucket_ms).collect()]
    want = [(e, c) for k, e, a, b in left for q, c, x, y in right if k == q and a < y and b > x]
    assert sorted(got) == sorted(want)


def test_an_entry_of_ten_years_is_few_rows(spark):
    entries = spark.createDataFrame([("a", 1, 0, 10 * YEAR), ("a", 2, 1000, 2500)], "k string, e int, start_ms bigint, end_ms bigint")
    spans = [60_000 << c for c in range(24)]
    clips = spark.createDataFrame([("a", c, 5 * YEAR, 5 * YEAR + span) for c, span in enumerate(spans)], "k string, c int, clip_start_ms bigint, clip_end_ms bigint")
    classed = entries.withColumn("_class", timeline._size_class(F.col("start_ms"), F.col("end_ms"), 60_000))
    rows = timeline._in_classes(classed, "start_ms", "end_ms", range(40), 60_000).groupBy("e").count().collect()
    assert max(r["count"] for r in rows) < 90 and {r.e: r["_class"] for r in classed.collect()} == {1: 23, 2: 0}
    got = timeline.interval_join(entries, clips, "k", (F.col("start_ms") < F.col("clip_end_ms")) & (F.col("end_ms") > F.col("clip_start_ms"))).collect()
    assert sorted(r.c for r in got) == list(range(24)) and {r.e for r in got} == {1}


def test_short_intervals_stay_one_class(spark):
    entries = spark.createDataFrame([("a", i, i * 1000, i * 1000 + 900) for i in range(200)], "k string, e int, start_ms bigint, end_ms bigint")
    classed = entries.withColumn("_class", timeline._size_class(F.col("start_ms"), F.col("end_ms"), 60_000))
    assert timeline._in_classes(classed, "start_ms", "end_ms", [0], 60_000).count() == 200
