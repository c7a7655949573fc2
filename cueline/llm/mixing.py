"""Mixing sources to target weights by hash-threshold histograms.

A document's hash is a fixed point in [0, 1), written as hexadecimal digits. A
source's budget is a number of whole passes over it and a rest, and the rest
takes the documents whose hash lies below a threshold. The threshold comes from
words summed by source and leading digits: the histogram's running sum names the
bucket in which the budget ends, only that bucket is refined by the next digits,
and the last refinement cuts where the sum is nearest to the budget. Nothing is
sorted, reruns agree, and a larger budget takes a superset of a smaller one.

Defined results: a null text has no words; null sources are one source, ranked
last. A null ``doc_id`` hashes like an empty one. Repeated rows share a hash and
are taken or left together. An empty table gives no rows; a source without words
has a target of 0, and its documents are taken with 0 words. Extra columns are
ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline.llm.tables import fresh, read, small
from cueline.session import materialise

WEIGHTS = (3, 1, 2)
#: Percent of all words that the mix takes, and passes over a source at most.
PERCENT, PASSES = 150, 2
#: Hexadecimal digits of the hash by which each histogram refines the one before.
DIGITS = (3, 3, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """The document's point in [0, 1) as hexadecimal digits."""
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))), 1, sum(DIGITS))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, passes: int = PASSES) -> DataFrame:
    """Add ``target`` to rows of (source, source_size), one per source.

    Sharing by weight and resharing what a full source can't take ends at
    ``min(passes * size, level * weight)``. Sources fill in the order of
    ``size / weight``; the level follows from the sums over those filled before.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    filling = Window.orderBy(F.col("full") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        ranked.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(passes))
        .withColumn("budget", F.sum("source_size").over(whole) * (percent / 100.0))
        .withColumn("left_words", F.col("budget") - F.coalesce(F.sum("full").over(filling), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        # A source that does not fill fixes the level for all behind it.
        .withColumn("fills", F.col("full") <= F.col("level") * F.col("weight"))
        .withColumn("common", F.max(F.when(~F.col("fills"), F.col("level"))).over(whole))
    )
    target = F.when(F.col("fills"), F.col("full")).otherwise(F.least("full", F.col("common") * F.col("weight")))
    return shared.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, n_goals: int, passes: int = PASSES) -> DataFrame:
    """``source, whole, cut``: whole passes, and the hash below which one more copy is taken.

    ``rows`` has (source, size, place). The cut compares with the leading digits
    of a place and takes those at or below it; it is empty where nothing more is
    taken.
    """
    goal = goals.select(
        F.col("source").alias("s"),
        F.least(F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)), F.lit(passes)).cast("int").alias("whole"),
        "source_size", "target",
    ).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).select("*", F.when(F.col("rest") > 0, "").otherwise("-").alias("prefix"), F.lit("").alias("cut"))
    length = 0
    for k, digits in enumerate(DIGITS):
        inside = rows.join(small(goal.select("s", "prefix"), n_goals), rows["source"].eqNullSafe(F.col("s")))
        inside = inside.where(F.substring("place", 1, length) == F.col("prefix"))
        length += digits
        buckets = inside.groupBy("s", F.substring("place", 1, length).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("s").orderBy("bucket")
        sums = buckets.withColumn("until", F.sum("words").over(running)).withColumnRenamed("s", "t")
        last = k == len(DIGITS) - 1
        # The last histogram cuts at the nearer side of the boundary bucket.
        fits = F.col("until") - F.col("words") / 2 <= F.col("rest") if last else F.col("until") <= F.col("rest")
        ends = (
            sums.join(small(goal.select("s", "rest"), n_goals), F.col("t").eqNullSafe(F.col("s")))
            .groupBy("t").agg(
                F.max(F.when(fits, F.col("bucket"))).alias("below"),
                F.max(F.when(fits, F.col("until"))).alias("taken"),
                F.min(F.when(~fits, F.col("bucket"))).alias("boundary"),
            )
        )
        joined = goal.join(ends, F.col("s").eqNullSafe(F.col("t")), "left")
        goal = materialise(
            joined.select(
                "s", "whole", "source_size", "target",
                (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("rest"), F.coalesce("boundary", F.lit("-")).alias("prefix"), F.coalesce("below", "cut").alias("cut"),
            ),
            f"mix-level-{k}",
        )
    return goal.select(F.col("s").alias("source"), "whole", "source_size", "target", "cut")


def copies(place: Column, whole: Column, cut: Column) -> Column:
    """How often a document is taken, given its source's ``whole`` and ``cut``.

    A cut of few digits, left by an earlier histogram, takes all places that
    start with it.
    """
    return whole + F.when((cut != "") & (F.substring(place, F.lit(1), F.length(cut)) <= cut), 1).otherwise(0)


def _plan(docs: DataFrame, weights: Sequence[int], percent: int, passes: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, source, size, place) of every row, the sources' thresholds, and the number of sources."""
    rows = materialise(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place")),
        "mix-rows",
    )
    sources = materialise(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, passes), "mix-targets"
    )
    n = sources.count()
    return rows, thresholds(rows, sources, n, passes), n


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, passes: int = PASSES) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``."""
    rows, plan, n = _plan(docs, weights, percent, passes)
    joined = rows.join(small(plan.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s")))
    return joined.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        (F.col("size") * copies(F.col("place"), F.col("whole"), F.col("cut"))).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, passes: int = PASSES) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    _, plan, n = _plan(docs, weights, percent, passes)
    source, whole, cut, copy = fresh(docs, "mix_source", "mix_whole", "mix_cut", "mix_copy")
    plan = plan.select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("cut").alias(cut))
    times = copies(place(F.col("doc_id"), F.col("text")), F.col(whole), F.col(cut))
    taken = docs.join(small(plan, n), F.col("source").eqNullSafe(F.col(source)))
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    digits = sum(DIGITS)
    return f"""
with recursive
d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size,
        substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, {digits}) place from documents),
s as (select source, cast(sum(size) as bigint) source_size,
        [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3] w from d group by source),
b as (select sum(source_size) * 1.5 budget, count(*) n from s),
-- level by level: sources above twice their size are full, the rest share again
r(step, source, source_size, w, is_full, level) as (
  select 0, source, source_size, w, false, (select budget from b) / sum(w) over () from s
  union all
  select step + 1, source, source_size, w, now_full,
    ((select budget from b) - coalesce(sum(case when now_full then 2.0 * source_size end) over (), 0))
      / nullif(sum(case when now_full then 0 else w end) over (), 0)
  from (select *, is_full or 2.0 * source_size <= level * w or level is null now_full from r where step < (select n from b))),
t as (select source, source_size, cast(case when is_full then 2.0 * source_size else level * w end as double) target
      from r where step = (select n from b)),
g as (select *, cast(least(floor(case when source_size > 0 then target / source_size else 0 end), 2) as bigint) whole from t),
p as (select source, place, sum(size) words from d group by all),
c as (select p.source, max(p.place) cut from (
        select source, place, sum(words) over (partition by source order by place) - words / 2.0 half from p) p
      join g on p.source is not distinct from g.source
      where g.target - g.whole * g.source_size > 0 and p.half <= g.target - g.whole * g.source_size group by p.source)
select d.doc_id, d.size, g.source_size, g.target,
  cast(d.size * (g.whole + case when d.place <= c.cut then 1 else 0 end) as bigint) taken
from d join g on d.source is not distinct from g.source left join c on d.source is not distinct from c.source"""


ORACLE_SQL = _oracle()
