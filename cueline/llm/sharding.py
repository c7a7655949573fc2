"""Sharding by longest-processing-time scheduling.

Documents of equal text form a group that must stay in one shard. Groups, sorted
by size, go to the least-loaded shard through a heap, which gives shards of
nearly equal bytes. The heap itself runs over a bounded list:

* a group of at least ``total / (shards * parts)`` bytes is scheduled alone;
  at most ``shards * parts`` groups can be that large;
* all smaller groups are dealt by a hash of their text into ``bundles`` bundles,
  and each bundle is scheduled as one item.

So the driver sees ``shards * parts + bundles`` sums whatever the input, while
groups, bundles, shards and slots are computed by Spark.

Defined results: a null text has no bytes and shares the group of the empty
text (checksum 0). Null and repeated ``doc_id`` values are documents like any
other; their order among equal ids is free. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.tables import read, text_key
from cueline.session import materialise

SHARDS = 40
#: Bytes that a document takes besides its text.
ROW_BYTES = 16
#: A group of 1 / PARTS of a shard's mean is scheduled alone.
PARTS = 250
BUNDLES = 16_384
#: Rows of a block inside which slots are counted.
BLOCK_ROWS = 50_000


def schedule(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest processing time first: name to shard; ties by name, then by the smaller shard."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for name, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS, bundles: int = BUNDLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            text_key(F.col("text")).alias("group"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    alone = max(1, total // (shards * parts))
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    units = (
        groups.select(F.when(F.col("bytes") >= alone, F.hex("group")).otherwise(bundle).alias("unit"), "bytes", "n")
        .groupBy("unit").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    )
    placed = schedule([(u.unit, u.bytes) for u in units], shards)
    lookup = spark.createDataFrame(
        [(u.unit, placed[u.unit], -(-u.n // block_rows)) for u in units],
        T.StructType([T.StructField("unit", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("blocks", T.LongType())]),
    )
    # Both lookups are bounded by shards * parts + bundles rows.
    whole = F.broadcast(lookup.where(F.length("unit") == 32).select(F.unhex("unit").alias("group"), F.col("unit").alias("own")))
    placed_rows = (
        rows.join(whole, "group", "left")
        .withColumn("unit", F.coalesce("own", bundle))
        .join(F.broadcast(lookup), "unit")
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), "blocks"))
    )
    return _slots(placed_rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless places in each shard: rows before the block, plus the place in it."""
    counts = placed.groupBy("shard", "unit", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("unit", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select("unit", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("unit", "block").orderBy("doc_id")
    return placed.join(blocks, ["unit", "block"]).withColumn("slot", F.col("first") + F.row_number().over(inside) - 1)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
