"""Ordered computations that never put one whole key into one task.

A transcript, a clip or an audio file is one key, and one key may hold a large
share of all rows. Every ordered operator therefore works on *blocks*: runs of
consecutive rows of a key, of bounded length. What crosses a block edge is
either a few copied rows (``over_neighbours``), one carried value per block
(``running_total``, ``running_max``), or a carried fold state that is checked
to be the true one (``ordered_fold``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cueline.session import materialise

BLOCK_ROWS = 50_000
"""Rows of one key that are processed together."""

TASK_BLOCKS = 4
"""Blocks that one task folds, on average."""

HEAVY_BUCKET_ROWS = 1_000_000
"""A time bucket with more rows than this is split further."""


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[str],
    order: Sequence[str],
    out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Number the rows of each key 0, 1, 2… without sorting a key in one task.

    ``blocks`` are columns whose order agrees with ``order`` and whose groups
    are small. Rows are ranked inside their block; the block's offset comes
    from a running count over the (small) table of block sizes. ``total``
    names an optional column with the number of rows of the key.
    """
    sizes = df.groupBy(*keys, *blocks).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*blocks)
    offsets = sizes.select(
        *keys,
        *blocks,
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
        *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, *blocks).orderBy(*order)
    return (
        df.join(offsets, [*keys, *blocks])
        .withColumn(out, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_before")
    )


def time_position(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str,
    out: str = "pos",
    total: str | None = None,
    bucket: int = 600_000,
    heavy_rows: int = HEAVY_BUCKET_ROWS,
) -> DataFrame:
    """Position of each row in ``(time, tie)`` order within its key.

    Rows are blocked by ``time div bucket``. A bucket with more than
    ``heavy_rows`` rows (many rows at one instant) is split by its exact time
    and by ranges of ``tie``, a row number unique in the key, so no block
    exceeds ``heavy_rows``. The table of heavy buckets has at most
    ``rows / heavy_rows`` rows; how it is joined is left to Spark. Whether there
    are any is counted first, so that without them ``df`` is shuffled once.
    """
    coarse = F.floor(F.col(time) / bucket).cast("long")
    tagged = df.withColumn("_b0", coarse)
    heavy = (
        tagged.groupBy(*keys, "_b0")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > heavy_rows)
        .select(*keys, "_b0", F.lit(True).alias("_heavy"))
    )
    if heavy.isEmpty():
        return dense_position(tagged, keys, ["_b0"], [time, tie], out, total).drop("_b0")
    tagged = (
        tagged.join(heavy, [*keys, "_b0"], "left")
        .withColumn("_b1", F.when(F.col("_heavy"), F.col(time)).otherwise(F.lit(0)).cast("long"))
        .withColumn(
            "_b2",
            F.when(F.col("_heavy"), F.floor(F.col(tie) / heavy_rows)).otherwise(F.lit(0)).cast("long"),
        )
        .drop("_heavy")
    )
    ranked = dense_position(tagged, keys, ["_b0", "_b1", "_b2"], [time, tie], out, total)
    return ranked.drop("_b0", "_b1", "_b2")


def with_halo(df: DataFrame, pos: str, before: int, after: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Assign rows to blocks of ``size`` positions, with copies at the edges.

    The last ``before`` rows of a block are copied into the next block and the
    first ``after`` rows into the previous one. ``_home`` is a row's own block.
    """
    if max(before, after) > size:
        raise ValueError("the halo must fit into one block")
    home = F.floor(F.col(pos) / size).cast("long")
    offset = F.pmod(F.col(pos), F.lit(size))
    late = offset >= size - before if before else F.lit(False)
    early = offset < after if after else F.lit(False)
    targets = (
        F.when(late & early, F.array(home, home + 1, home - 1))
        .when(late, F.array(home, home + 1))
        .when(early, F.array(home, home - 1))
        .otherwise(F.array(home))
    )
    return df.withColumn("_home", home).withColumn("_block", F.explode(targets))


def over_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: dict[str, Callable[[Any], Column]],
    before: int = 1,
    after: int = 0,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns computed from a few rows before and after each row.

    Each entry of ``columns`` maps a name to a function of a window ordered by
    ``pos``; it may look ``before`` rows back and ``after`` rows ahead. ``pos``
    must be dense within the key. One shuffle, of single blocks.
    """
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    blocks = with_halo(df, pos, before, after, size)
    return (
        blocks.select("*", *[make(window).alias(name) for name, make in columns.items()])
        .where(F.col("_home") == F.col("_block"))
        .drop("_home", "_block")
    )


def _carried(df, keys, pos, aggregates, size):
    """Rows with their block number and, per block, the aggregate of earlier blocks."""
    blocks = df.withColumn("_block", F.floor(F.col(pos) / size).cast("long"))
    parts = blocks.groupBy(*keys, "_block").agg(
        *[agg(F.col(source)).alias(f"_{out}") for out, (source, agg) in aggregates.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = parts.select(
        *keys, "_block", *[agg(F.col(f"_{out}")).over(earlier).alias(f"_{out}") for out, (_, agg) in aggregates.items()]
    )
    return blocks.join(carry, [*keys, "_block"])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: dict[str, str],
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Sum of ``source`` over all earlier rows of the key, the row itself excluded."""
    rows = _carried(df, keys, pos, {o: (s, F.sum) for o, s in columns.items()}, size)
    inside = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    for out, source in columns.items():
        rows = rows.withColumn(
            out, F.coalesce(F.col(f"_{out}"), F.lit(0)) + F.sum(source).over(inside) - F.col(source)
        )
    return rows.drop("_block", *[f"_{o}" for o in columns])


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: dict[str, str],
    inclusive: bool = True,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Largest ``source`` over the rows so far; NULL where there is none."""
    rows = _carried(df, keys, pos, {o: (s, F.max) for o, s in columns.items()}, size)
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    for out, source in columns.items():
        rows = rows.withColumn(out, F.greatest(F.col(f"_{out}"), F.max(source).over(inside)))
    return rows.drop("_block", *[f"_{o}" for o in columns])


# -- folds ---------------------------------------------------------------------


class Fold:
    """A left-to-right recurrence over the rows of one key.

    ``push`` takes one row (a dict) and returns finished output tuples;
    ``flush`` returns what is still held at the end of the key. ``state`` must
    describe everything later outputs depend on, as a tuple of plain values.
    """

    def push(self, row: dict) -> list[tuple]:
        raise NotImplementedError

    def push_many(self, columns: dict[str, list], first: int, stop: int) -> list[tuple]:
        """What ``push`` returns for the rows from ``first`` to before ``stop``, one after another."""
        out = []
        for values in zip(*(c[first:stop] for c in columns.values())):
            out += self.push(dict(zip(columns, values)))
        return out

    def flush(self) -> list[tuple]:
        return []

    def state(self) -> tuple:
        raise NotImplementedError


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    total: str,
    make_fold: Callable[[tuple], Fold],
    out_fields: Sequence[T.StructField],
    size: int = BLOCK_ROWS,
    warmup: int = 2_000,
    name: str = "fold",
) -> DataFrame:
    """Run a sequential fold over every key, many blocks of a key at a time.

    Each block starts ``warmup`` rows early from an empty state and drops what
    it emits there; by the first row of its own it normally holds the state a
    run from the start of the key would hold. That is checked, not assumed:
    the state each block ended in must equal the state the next one entered
    with. Where it does, the output equals that of one sequential run. A key
    with an edge that differs is folded again with larger blocks and a longer
    warm-up, in the limit in one block. Rows stream through the worker in
    order, so memory does not grow with the key.

    ``make_fold`` receives the key values. The result has the key columns,
    ``out_fields``, and ``_block, _seq``: results of a key in the order in which
    they were emitted. It is a table in the shared folder. A key whose edges
    differ is repeated alone; the results of all other keys stand.
    """
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(
        [
            *key_fields,
            T.StructField("_block", T.LongType()),
            T.StructField("_mark", T.StringType()),
            T.StructField("_state", T.StringType()),
            T.StructField("_seq", T.LongType()),
            *[T.StructField(f.name, f.dataType, True) for f in out_fields],
        ]
    )
    out_names = [f.name for f in out_fields]
    # bound by computing, not by bytes: a task for every few blocks, one for each core at least
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done: DataFrame | None = None
    while True:
        tasks = max(least, -(-df.count() // (TASK_BLOCKS * BLOCK_ROWS)))
        blocks = (
            with_halo(df, pos, min(warmup, size), 0, size)
            .where(F.col("_block") * size < F.col(total))
            .repartition(tasks, *keys, "_block")
            .sortWithinPartitions(*keys, "_block", pos)
        )
        runner = _block_runner(keys, pos, total, make_fold, to_arrow_schema(schema), len(out_names))
        table = materialise(blocks.mapInArrow(runner, schema), name, "zstd")
        left = table.where("_mark = 'exit'").select(*keys, (F.col("_block") + 1).alias("_block"), "_state")
        entered = table.where("_mark = 'entry'").select(*keys, "_block", F.col("_state").alias("_entered"))
        wrong = left.join(entered, [*keys, "_block"]).where(F.col("_state") != F.col("_entered"))
        again = wrong.select(*keys).distinct()
        rows = table.where("_mark = 'row'").select(*keys, "_block", "_seq", *out_names)
        if wrong.isEmpty():
            return rows if done is None else done.unionByName(rows)
        again = materialise(again, f"{name}-again")
        right = rows.join(again, keys, "left_anti")
        done = right if done is None else done.unionByName(right)
        df = df.join(again, keys, "left_semi")
        size, warmup = size * 16, warmup * 16


def _values(column: pa.Array) -> list:
    """A column as Python values; the common types without a scalar object for each value."""
    kind = column.type
    if pa.types.is_string(kind) or (not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _block_runner(keys, pos, total, make_fold, arrow_schema, width):
    blanks = (None,) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold, own, done, seq = None, None, False, False, 0

        def leave():
            if current is not None and own and not done:
                return [(*current, "exit", repr(fold.state()), None, *blanks)]
            return []

        def pack(rows):
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema
            )

        for batch in batches:
            rows = []
            columns = dict(zip(batch.schema.names, map(_values, batch.columns)))
            groups = list(zip(*(columns[c] for c in (*keys, "_block"))))
            edges = [i for i in range(1, len(groups)) if groups[i] != groups[i - 1]]
            for first, stop in zip([0, *edges], [*edges, len(groups)]):
                if groups[first] != current:
                    rows += leave()
                    current, fold, own, done, seq = groups[first], make_fold(groups[first][:-1]), False, False, 0
                if not own:
                    home, block = columns["_home"], current[-1]
                    begin = next((i for i in range(first, stop) if home[i] == block), stop)
                    fold.push_many(columns, first, begin)
                    if begin == stop:
                        continue
                    first, own = begin, True
                    rows.append((*current, "entry", repr(fold.state()), None, *blanks))
                emitted = fold.push_many(columns, first, stop)
                if columns[pos][stop - 1] == columns[total][stop - 1] - 1:
                    emitted = emitted + fold.flush()
                    done = True
                rows += [(*current, "row", None, seq + n, *out) for n, out in enumerate(emitted)]
                seq += len(emitted)
            if rows:
                yield pack(rows)
        rows = leave()
        if rows:
            yield pack(rows)

    return run
