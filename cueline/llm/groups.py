"""Groups of rows that must meet pairwise, in tiles of bounded size, and components of links.

A group may hold a third of all rows, so it is never gathered whole. Its members
are dealt into tiles by a hash; every pair of tiles is a task of its own, and each
pair of members meets in exactly one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.session import materialise


def tiled(members: DataFrame, group: str, member: str, weight: Column, tile_rows: int, tile_weight: int) -> DataFrame:
    """Members of groups of two or more, once for each pair of tiles ``(low, high)`` they take part in.

    Adds ``tile``, ``low`` and ``high``. A tile holds about ``tile_rows`` members
    and ``tile_weight`` of the summed ``weight`` at most, by expectation.
    """
    sizes = members.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).where("n > 1")
    tiles = F.ceil(F.greatest(F.col("n") / tile_rows, F.col("w") / tile_weight)).cast("int")
    met = members.join(sizes.select("g", tiles.alias("tiles")), F.col(group) == F.col("g")).drop("g")
    dealt = met.withColumn("tile", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("tiles")).cast("int"))
    partner = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return partner.select(
        *members.columns, "tile", F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups (many at once) from batches sorted by ``keys``."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        last = starts_of(table, keys)[-1]
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a group begins; integer keys without nulls."""
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component under the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            return root


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    if len(left) * (20_000 + 20 * sizes.mean()) < 0.1 * len(sets) ** 2 * len(shared) + 1e6:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())], int)
    # Many pairs: products of the membership matrix, some columns at a time.
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    rows, columns = np.repeat(np.arange(len(sets)), sizes), column[inverse]
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for first in range(0, len(shared), width):
        low, high = np.searchsorted(columns, [first, first + width])
        member = np.zeros((len(sets), width), np.float32)
        member[rows[low:high], columns[low:high] - first] = 1
        total += member @ member.T
    return total[left, right].astype(int)


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` of every node of ``edges`` (left, right): the smallest node of its component.

    Each round hangs every node on its smallest neighbour and contracts; rounds
    grow with the logarithm of the longest chain. No component is gathered.
    """
    edges = materialise(edges.where("left != right").distinct(), f"{name}-edges")
    roots: DataFrame | None = None
    step = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("right").alias("left"), F.col("left").alias("right")))
        parents = materialise(
            both.groupBy(F.col("left").alias("node")).agg(F.min("right").alias("least")).select("node", F.least("node", "least").alias("parent")),
            f"{name}-parents-{step}",
        )
        if roots is None:
            roots = parents.withColumnRenamed("parent", "root")
        else:
            moved = parents.withColumnRenamed("node", "at")
            roots = roots.join(moved, roots["root"] == moved["at"], "left").select("node", F.coalesce("parent", "root").alias("root"))
        roots = materialise(roots, f"{name}-roots-{step}")
        up, down = (parents.select(F.col("node").alias(f"{side}_node"), F.col("parent").alias(f"{side}_parent")) for side in ("l", "r"))
        lifted = edges.join(up, F.col("left") == F.col("l_node")).join(down, F.col("right") == F.col("r_node"))
        edges = materialise(
            lifted.where("l_parent != r_parent").select(F.col("l_parent").alias("left"), F.col("r_parent").alias("right")).distinct(),
            f"{name}-edges-{step}",
        )
        step += 1
    return roots if roots is not None else edges.select(F.col("left").alias("node"), F.col("right").alias("root"))
