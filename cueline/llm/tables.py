"""Small helpers of the operators: reading tables, names that clash with none, bounded lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table, whose rows are counted first, is sent to every executor.
LOOKUP_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores appended until no column of ``df`` has the name."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def text_key(text: Column) -> Column:
    """128 bits that equal texts share; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of ``df`` when its counted ``rows`` are few; else leave the join to Spark."""
    return F.broadcast(df) if rows <= LOOKUP_ROWS else df
