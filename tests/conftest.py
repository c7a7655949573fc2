import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cueline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "cueline-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a text expression on literal rows: value(f, "a", "b") gives a list."""
    from pyspark.sql import functions as F

    def run(make, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        return [r.v for r in rows.select("i", make(F.col("text")).alias("v")).orderBy("i").collect()]

    return run


def segments_of(spark, rows, transcript="t"):
    """Segments of one transcript in time order from (start, end, text)."""
    data = [(transcript, i, s, e, t, i, len(rows)) for i, (s, e, t) in enumerate(rows)]
    return spark.createDataFrame(
        data, "transcript_id string, seg_idx bigint, start_ms bigint, end_ms bigint, text string, pos bigint, n_rows bigint"
    )
