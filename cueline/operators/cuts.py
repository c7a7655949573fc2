"""Cuts of a key by collected length, with any number of rows and no sequential task.

A row opens a run if enough length was collected since the last cut: ``high``, or
``low`` where the row is marked. What a block of rows does to the length ``h``
collected before it is one step function: for ``h`` below all thresholds nothing is
cut and ``h`` grows by the block's total; from a threshold on, the first cut
is a fixed row, and everything after it no longer depends on ``h``. Such a *transfer
table* has one piece per row of the first window of ``high`` at most, however
many rows the block has, and two tables compose to one of the same kind.

Tables are composed in a tree of ``fan_out`` until one task holds a key's top
level, states are handed down the same tree, and every block then marks its own rows.
Nothing is guessed and nothing is repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.operators.ordered import BLOCK_ROWS
from cueline.session import materialise

FAN_OUT = 256
"""Tables that are composed to one."""

_ALL = 1 << 62  # collected before the first row, which always opens a run


class State(NamedTuple):
    """Length collected since the last cut, cuts so far, and the last cut's position."""

    have: int
    cuts: int
    last: int


class Table(NamedTuple):
    """Pieces by rising threshold: what a block leaves if ``h`` is at least the threshold."""

    thresholds: np.ndarray
    have: np.ndarray
    cuts: np.ndarray
    last: np.ndarray
    total: int

    def apply(self, state: State) -> State:
        piece = int(np.searchsorted(self.thresholds, state.have, "right")) - 1
        if piece < 0:
            return State(state.have + self.total, state.cuts, state.last)
        return State(int(self.have[piece]), state.cuts + int(self.cuts[piece]), int(self.last[piece]))


def _reachable(table: Table, least: int) -> Table:
    """Without pieces below ``least`` and without edges between equal pieces."""
    first = max(int(np.searchsorted(table.thresholds, least, "right")) - 1, 0)
    keep = np.arange(len(table.thresholds)) >= first
    same = (table.last[1:] == table.last[:-1]) & (table.cuts[1:] == table.cuts[:-1]) & (table.have[1:] == table.have[:-1])
    keep[first + 1 :] &= ~same[first:]
    return Table(table.thresholds[keep], table.have[keep], table.cuts[keep], table.last[keep], table.total)


def compose(first: Table, second: Table, least: int) -> Table:
    """The table of ``first`` followed by ``second``."""
    piece = np.searchsorted(second.thresholds, first.have, "right") - 1
    passed = piece < 0
    at = np.maximum(piece, 0)
    if len(second.thresholds):
        have = np.where(passed, first.have + second.total, second.have[at])
        cuts = first.cuts + np.where(passed, 0, second.cuts[at])
        last = np.where(passed, first.last, second.last[at])
    else:
        have, cuts, last = first.have + second.total, first.cuts, first.last
    moved = second.thresholds - first.total
    below = moved < (first.thresholds[0] if len(first.thresholds) else math.inf)
    joined = Table(
        np.concatenate([moved[below], first.thresholds]), np.concatenate([second.have[below], have]), np.concatenate([second.cuts[below], cuts]),
        np.concatenate([second.last[below], last]), first.total + second.total,
    )
    return _reachable(joined, least)


class Block:
    """The rows of one block in order, and where the next cut after each row is."""

    def __init__(self, lengths: np.ndarray, marked: np.ndarray, first: int, low: int, high: int):
        self.first, self.low, self.high = first, low, max(low, high)
        sums = np.cumsum(lengths)
        self.before, self.total = np.concatenate([[0], sums[:-1]]), int(sums[-1])
        self.thresholds = np.where(marked, self.low, self.high) - self.before
        self.rising = bool((lengths >= 0).all())
        self.marked = np.flatnonzero(marked)
        self.before_marked = self.before[self.marked]

    def after(self, row: int) -> int:
        """The next cut after the cut at ``row``; the number of rows if there is none."""
        base, n = self.before[row], len(self.before)
        if self.rising:
            plain = max(row + 1, int(np.searchsorted(self.before, base + self.high)))
            place = max(int(np.searchsorted(self.marked, row + 1)), int(np.searchsorted(self.before_marked, base + self.low)))
            return min(plain, int(self.marked[place])) if place < len(self.marked) else plain
        first, span = row + 1, 64
        while first < n:
            hit = self.thresholds[first : first + span] <= -base
            if hit.any():
                return first + int(np.argmax(hit))
            first, span = first + span, span * 2
        return n

    def table(self, least: int) -> Table:
        lowest = np.minimum.accumulate(self.thresholds)
        firsts = np.flatnonzero(np.concatenate([[True], lowest[1:] < lowest[:-1]]))
        firsts = firsts[: int(np.argmax(self.thresholds[firsts] <= least)) + 1] if (self.thresholds[firsts] <= least).any() else firsts
        ends: dict[int, tuple[int, int]] = {}  # row of a cut: cuts from there on, last cut
        for row in firsts[::-1].tolist():
            chain = []
            while row < len(self.before) and row not in ends:
                chain.append(row)
                row = self.after(row)
            cuts, last = ends.get(row, (0, -1))
            for row in reversed(chain):
                cuts, last = cuts + 1, last if last >= 0 else row
                ends[row] = cuts, last
        firsts = firsts[::-1]
        last = np.array([ends[r][1] for r in firsts.tolist()], np.int64)
        cuts = np.array([ends[r][0] for r in firsts.tolist()], np.int64)
        return _reachable(Table(self.thresholds[firsts], self.total - self.before[last], cuts, last + self.first, self.total), least)

    def mark(self, state: State) -> tuple[np.ndarray, np.ndarray]:
        """Number and first position of the run of every row."""
        n = len(self.before)
        opens = self.thresholds <= state.have
        row, rows = int(np.argmax(opens)) if opens.any() else n, []
        while row < n:
            rows.append(row)
            row = self.after(row)
        cut = np.zeros(n, np.int64)
        cut[rows] = 1
        numbers = np.cumsum(cut)
        starts = np.concatenate([[state.last], np.array(rows, np.int64) + self.first])
        return state.cuts + numbers, starts[numbers]


def _integers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _stored(tables: pa.Table) -> Iterator[tuple[int, Table]]:
    for row in tables.sort_by("_block").to_pylist():
        yield row["_block"], Table(*(np.array(row[c], np.int64) for c in ("_thresholds", "_have", "_cuts", "_last")), row["_total"])


_TABLE = "_block bigint, _thresholds array<bigint>, _have array<bigint>, _cuts array<bigint>, _last array<bigint>, _total bigint"
_STATE = "_block bigint, _at_have bigint, _at_cuts bigint, _at_last bigint"


def cut_runs(
    df: DataFrame, keys: Sequence[str], pos: str, length: str, marked: str, low: float, high: float,
    number: str, start: str, size: int = BLOCK_ROWS, fan_out: int = FAN_OUT,
) -> DataFrame:
    """``df`` with the ``number`` (1, 2, …) and the ``start`` (first ``pos``) of each row's run.

    ``pos`` is dense within the key; ``length`` holds whole numbers, which may be
    negative; ``marked`` tells rows that open a run from ``low`` on.
    """
    keys, low, high = list(keys), math.ceil(low), math.ceil(high)
    key_schema = [df.schema[k] for k in keys]
    table_schema = T.StructType([*key_schema, *T.StructType.fromDDL(_TABLE).fields])
    state_schema = T.StructType([*key_schema, *T.StructType.fromDDL(_STATE).fields])
    blocks = df.withColumn("_block", F.floor(F.col(pos) / size).cast("long"))
    # nothing below this was ever collected, since only negative lengths lower it
    least = int(df.agg(F.sum(F.least(F.col(length), F.lit(0)).cast("long"))).first()[0] or 0)

    def block_of(rows: pa.Table) -> Block:
        return Block(_integers(rows[length]), rows[marked].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False), rows[pos][0].as_py(), low, high)

    def row_of(key: tuple, block: int, table: Table) -> pa.Table:
        values = {**{k: [v.as_py()] for k, v in zip(keys, key)}, "_block": [block], "_thresholds": [table.thresholds], "_have": [table.have], "_cuts": [table.cuts], "_last": [table.last], "_total": [table.total]}
        return pa.table(values)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        return row_of(key[:-1], key[-1].as_py(), block_of(rows.sort_by(pos)).table(least))

    def join(key: tuple, tables: pa.Table) -> pa.Table:
        whole = None
        for _, table in _stored(tables):
            whole = table if whole is None else compose(whole, table, least)
        return row_of(key[:-1], key[-1].as_py(), whole)

    def walk(key: tuple, tables: pa.Table, above: pa.Table | None) -> pa.Table:
        state = State(_ALL, 0, -1)
        if above is not None:
            state = State(*(above[c][0].as_py() for c in ("_at_have", "_at_cuts", "_at_last")))
        rows = []
        for block, table in _stored(tables):
            rows.append({**{k: v.as_py() for k, v in zip(keys, key)}, "_block": block, "_at_have": state.have, "_at_cuts": state.cuts, "_at_last": state.last})
            state = table.apply(state)
        return pa.Table.from_pylist(rows)

    def mark(key: tuple, rows: pa.Table, states: pa.Table) -> pa.Table:
        rows = rows.sort_by(pos)
        numbers, starts = block_of(rows).mark(State(*(states[c][0].as_py() for c in ("_at_have", "_at_cuts", "_at_last"))))
        return rows.drop_columns(["_block"]).append_column(number, pa.array(numbers)).append_column(start, pa.array(starts))

    narrow = blocks.select(*keys, "_block", pos, length, marked)
    levels = [materialise(narrow.groupBy(*keys, "_block").applyInArrow(build, table_schema), "cut-tables")]
    top = levels[0].agg(F.max("_block")).first()[0] or 0
    while top >= fan_out:
        above = levels[-1].withColumn("_up", F.floor(F.col("_block") / fan_out).cast("long"))
        levels.append(materialise(above.groupBy(*keys, "_up").applyInArrow(join, table_schema), "cut-tables"))
        top //= fan_out
    states = levels.pop().groupBy(*keys).applyInArrow(lambda key, tables: walk(key, tables, None), state_schema)
    while levels:
        below = levels.pop().withColumn("_up", F.floor(F.col("_block") / fan_out).cast("long"))
        states = below.groupBy(*keys, "_up").cogroup(states.groupBy(*keys, "_block")).applyInArrow(lambda key, tables, above: walk(key[:-1], tables, above), state_schema)
    out = T.StructType([*df.schema.fields, T.StructField(number, T.LongType()), T.StructField(start, T.LongType())])
    return blocks.groupBy(*keys, "_block").cogroup(states.groupBy(*keys, "_block")).applyInArrow(mark, out)
