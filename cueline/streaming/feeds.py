"""Append-shaped feeds read incrementally: only files not seen before are read.

The file source's own record of finished files replaces a manifest check: a
second run over the same folder does no work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.sources.readers import CANONICAL, LOG


def count_new_log_lines(spark: SparkSession, path: str, out: str, state: str) -> None:
    """Append the level counts of log files that arrived since the last run.

    ``state`` is the query's checkpoint folder. Each micro-batch has a folder
    ``batch_id=<n>`` of one row per level, so totals are a sum over the small
    output table, and a batch that is run again replaces itself.
    """
    lines = spark.readStream.schema(LOG).json(path).where("level is not null")

    def append(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = lines.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()


def new_transcripts(spark: SparkSession, path: str, process, state: str) -> None:
    """Hand the segments of canonical transcripts that arrived since the last run
    to ``process(batch, batch_id)``, which may use every batch operator."""
    docs = spark.readStream.schema(CANONICAL).json(path)
    rows = docs.select("transcript_id", F.inline("segments"))
    query = rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(process).start()
    query.awaitTermination()
