"""Product quantisation in whole numbers by a dual-tree Lloyd iteration.

Every component becomes ``floor(1024 * x)``; vectors are cut into four equal parts,
and each part position has a codebook that starts as that part of the first
vectors and is refined by Lloyd rounds.

Vectors are stored once, in blocks. A block holds, for each part position, its parts in
the order of a balanced box tree, with the box and the *cached sum* of each node.
In a round every task meets the tree of a block with the tree of the codebook's entries:

* a pair of nodes is dropped when the least distance between its boxes is above the
  greatest distance to another entry node of the same part node;
* a single entry is dropped for a part node when another entry is nearer to every corner
  of the node's box;
* a part node with one entry left is assigned as a whole, by its cached sum;
* in leaves with several entries left, exact integer distances decide. They are computed in
  doubles where every intermediate is an integer below 2^53, else in 64-bit integers.

All bounds are integers, so ties reach the leaves and go to the lower index. A task sends one sum per
entry; rounds shuffle nothing else, and the driver holds the codebooks (256 vectors).

Defined results: vectors that are null or hold null or non-finite components are dropped. Rows
with an equal or no ``vec_id`` are coded each; the first 256 rows are ordered by ``vec_id``
(null last), then by vector. Vectors of different dimensions have codebooks of their own. A dimension
that four does not divide counts as followed by zeros. A component so large that an error
could exceed a long (131,071 at 64 components) is cut to that bound. Fewer than 256 rows give fewer
entries; unused entries stay. A sum of errors above a long is null. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.tables import LOOKUP_ROWS, read
from cueline.llm.vectors import finite_vectors, floors, is_finite
from cueline.session import materialise

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Parts in a leaf, at most; entries in a leaf of the codebook's tree.
LEAF, ENTRY_LEAF = 64, 4
#: Salts of the join on labels where they are too many to broadcast.
SALTS = 64
_PAIRS = 1 << 15


class Tree(NamedTuple):
    """A balanced tree over rows of integers; level ``l`` has ``2**l`` nodes of equal length.

    ``order`` are the rows in tree order, and node ``i`` of level ``l`` is place ``2**l - 1 + i`` in
    the boxes ``low``, ``high`` and in ``sums``.
    """

    levels: int
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    def edges(self, level: int) -> np.ndarray:
        """First rows of the nodes of a level, and the end."""
        return np.arange(2**level + 1) * len(self.order) // 2**level


def build_tree(points: np.ndarray, leaf: int) -> Tree:
    """Split every node at the middle of its widest component until leaves hold ``leaf`` rows."""
    n, width = points.shape
    levels = max(0, math.ceil(math.log2(max(n, 1) / leaf))) if width else 0
    order, low, high, sums = np.arange(n), [], [], []
    for level in range(levels + 1):
        edges = np.arange(2**level + 1) * n // 2**level
        rows = points[order]
        low.append(np.minimum.reduceat(rows, edges[:-1], axis=0))
        high.append(np.maximum.reduceat(rows, edges[:-1], axis=0))
        sums.append(np.add.reduceat(rows, edges[:-1], axis=0))
        if level < levels:
            node = np.repeat(np.arange(2**level), np.diff(edges))
            widest = np.argmax(high[-1] - low[-1], axis=1)
            order = order[np.lexsort((rows[np.arange(n), widest[node]], node))]
    return Tree(levels, order, np.concatenate(low), np.concatenate(high), np.concatenate(sums))


class Found(NamedTuple):
    """What a traversal decides: whole nodes with their entry, and uncertain leaves with theirs."""

    nodes: np.ndarray
    entries: np.ndarray
    leaves: list[tuple[int, int, np.ndarray]]


def _least_and_greatest(tree: Tree, other: Tree, p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance bounds of node pairs."""
    least, greatest = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    for first in range(0, len(p), _PAIRS):
        run = slice(first, first + _PAIRS)
        above, below = other.low[e[run]] - tree.high[p[run]], tree.low[p[run]] - other.high[e[run]]
        gap = np.maximum(np.maximum(above, below), 0)
        far = np.maximum(other.high[e[run]] - tree.low[p[run]], tree.high[p[run]] - other.low[e[run]])
        least[run], greatest[run] = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
    return least, greatest


def _undominated(low: np.ndarray, high: np.ndarray, best: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether some point of the box is at least as near to ``other`` as to ``best``; rows are pairs."""
    step = other - best
    corner = np.where(step > 0, high, low)
    return ((2 * corner - best - other) * step).sum(axis=1) >= 0


def _first_of_runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def traverse(tree: Tree, entries: Tree, codebook: np.ndarray) -> Found:
    """Walk both trees together, level by level."""
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)  # places in the trees, pairs sorted by part node
    single = np.empty(0, np.int64)
    whole, chosen, leaves = [], [], []
    for step in range(max(tree.levels, entries.levels + 1) + 1):
        on_entries = step > entries.levels
        if not on_entries:
            least, greatest = _least_and_greatest(tree, entries, p, e)
            starts = _first_of_runs(p)
            bound = np.repeat(np.minimum.reduceat(greatest, starts), np.diff(np.append(starts, len(p))))
            p, e = p[least <= bound], e[least <= bound]
        else:
            if step == entries.levels + 1:  # from leaves of the entry tree to its entries
                edges = entries.edges(entries.levels)
                leaf = e - (2**entries.levels - 1)
                counts = edges[leaf + 1] - edges[leaf]
                place = np.repeat(edges[leaf] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                p, single = np.repeat(p, counts), entries.order[place]
            middle = tree.low[p] + tree.high[p]
            twice = 2 * codebook[single] - middle
            near = (twice * twice).sum(axis=1)
            order = np.lexsort((single, near, p))
            p, single = p[order], single[order]
            starts = _first_of_runs(p)
            best = np.repeat(single[starts], np.diff(np.append(starts, len(p))))
            keep = (single == best) | _undominated(tree.low[p], tree.high[p], codebook[best], codebook[single])
            p, single = p[keep], single[keep]
            starts = _first_of_runs(p)
            counts = np.diff(np.append(starts, len(p)))
            alone = starts[counts == 1]
            whole.append(p[alone])
            chosen.append(single[alone])
            left = np.repeat(counts > 1, counts)
            p, single = p[left], single[left]
            if len(p) == 0:
                return Found(np.concatenate(whole), np.concatenate(chosen), leaves)
        if step >= tree.levels and on_entries:
            break
        down = step < tree.levels
        if not on_entries and step < entries.levels:
            if down:
                p, e = np.repeat(2 * p + 1, 4), np.repeat(2 * e + 1, 4)
                p[2::4] += 1
                p[3::4] += 1
                e[1::4] += 1
                e[3::4] += 1
            else:
                p, e = np.repeat(p, 2), np.repeat(2 * e + 1, 2)
                e[1::2] += 1
        elif down:
            if on_entries:
                p, single = np.concatenate([2 * p + 1, 2 * p + 2]), np.concatenate([single, single])
                order = np.argsort(p, kind="stable")
                p, single = p[order], single[order]
            else:
                p, e = np.concatenate([2 * p + 1, 2 * p + 2]), np.concatenate([e, e])
        if not on_entries:
            order = np.argsort(p, kind="stable")
            p, e = p[order], e[order]
    edges = tree.edges(tree.levels)
    starts = np.append(_first_of_runs(p), len(p))
    for first, last in zip(starts[:-1], starts[1:]):
        node = p[first] - (2**tree.levels - 1)
        leaves.append((edges[node], edges[node + 1], np.sort(single[first:last])))
    return Found(np.concatenate(whole), np.concatenate(chosen), leaves)


class Assigned(NamedTuple):
    """Rows (in tree order) of uncertain leaves and their entries, and whole nodes and theirs."""

    rows: np.ndarray
    row_entries: np.ndarray
    nodes: np.ndarray
    node_entries: np.ndarray


def assign(points: np.ndarray, tree: Tree, codebook: np.ndarray) -> Assigned:
    """The nearest entry of every row of ``points``, which are in tree order."""
    found = traverse(tree, build_tree(codebook, ENTRY_LEAF), codebook)
    most = int(max(np.abs(tree.low[0]).max(initial=0), np.abs(tree.high[0]).max(initial=0), np.abs(codebook).max(initial=0)))
    small = 4 * max(points.shape[1], 1) * most * most < 2**53
    numbers = points.astype(np.float64) if small else points
    centres = codebook.astype(np.float64) if small else codebook
    squares = (centres * centres).sum(axis=1) if small else None
    rows, entries = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first, last, near in found.leaves:
        if small:
            distance = squares[near] - 2 * (numbers[first:last] @ centres[near].T)
        else:
            distance = np.stack([((numbers[first:last] - centres[c]) ** 2).sum(axis=1) for c in near], axis=1)
        rows.append(np.arange(first, last))
        entries.append(near[np.argmin(distance, axis=1)])
    return Assigned(np.concatenate(rows), np.concatenate(entries), found.nodes, found.entries)


def entry_of_rows(assigned: Assigned, tree: Tree) -> np.ndarray:
    """The entry of each row, in tree order."""
    entries = np.empty(len(tree.order), np.int64)
    entries[assigned.rows] = assigned.row_entries
    level = np.floor(np.log2(assigned.nodes + 1)).astype(np.int64)
    place = assigned.nodes + 1 - 2**level
    first, last = place * len(entries) // 2**level, (place + 1) * len(entries) // 2**level
    entries[np.repeat(first - np.cumsum(last - first) + (last - first), last - first) + np.arange((last - first).sum())] = np.repeat(assigned.node_entries, last - first)
    return entries


def sums_of_entries(points: np.ndarray, assigned: Assigned, tree: Tree, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the rows of each entry; whole nodes give their cached sums."""
    count, total = np.zeros(entries, np.int64), np.zeros((entries, points.shape[1]), np.int64)
    np.add.at(count, assigned.row_entries, 1)
    np.add.at(total, assigned.row_entries, points[assigned.rows])
    level = np.floor(np.log2(assigned.nodes + 1)).astype(np.int64)
    place = assigned.nodes + 1 - 2**level
    n = len(points)
    np.add.at(count, assigned.node_entries, (place + 1) * n // 2**level - place * n // 2**level)
    np.add.at(total, assigned.node_entries, tree.sums[assigned.nodes])
    return count, total


def largest_component(dimension: int) -> int:
    """The bound of components under which every error fits a long."""
    return (1 << 31 - math.ceil(math.log2(max(dimension, 4)) / 2) - 1) - 1


_STORED = pa.struct([("points", pa.binary()), ("order", pa.binary()), ("nodes", pa.binary())])
_PART = T.StructType().add("points", "binary").add("order", "binary").add("nodes", "binary")


def build_blocks(vectors: DataFrame) -> DataFrame:
    """``dimension, vec_ids, labels, parts``: blocks of an Arrow batch of vectors, with their trees."""
    schema = T.StructType().add("dimension", "integer")
    schema.add("vec_ids", T.ArrayType(vectors.schema["vec_id"].dataType)).add("labels", T.ArrayType(vectors.schema["label"].dataType)).add("parts", T.ArrayType(_PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in finite_vectors(batch.column("embedding")):
                dimension = matrix.shape[1]
                width = -(-dimension // PARTS)
                numbers = np.zeros((len(rows), PARTS * width), np.int64)
                numbers[:, :dimension] = floors(matrix, largest_component(dimension))
                parts = []
                for i in range(PARTS):
                    part = numbers[:, i * width : (i + 1) * width]
                    tree = build_tree(part, LEAF)
                    parts.append({"points": part[tree.order].astype(np.int32).tobytes(), "order": tree.order.astype(np.int32).tobytes(), "nodes": np.stack([tree.low, tree.high, tree.sums]).tobytes()})
                place = pa.array(rows)
                lists = [pa.array([batch.column(c).take(place).to_pylist()], pa.list_(batch.column(c).type)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array([dimension], pa.int32()), *lists, pa.array([parts], pa.list_(_STORED))], names=["dimension", "vec_ids", "labels", "parts"])

    return vectors.select("vec_id", "embedding", "label").mapInArrow(run, schema)


def _part(stored: dict, n: int, width: int) -> tuple[np.ndarray, Tree]:
    points = np.frombuffer(stored["points"], np.int32).reshape(n, width).astype(np.int64)
    order = np.frombuffer(stored["order"], np.int32).astype(np.int64)
    levels = max(0, math.ceil(math.log2(max(n, 1) / LEAF))) if width else 0
    low, high, sums = np.frombuffer(stored["nodes"], np.int64).reshape(3, 2 ** (levels + 1) - 1, width)
    return points, Tree(levels, order, low, high, sums)


def _first_entries(vectors: DataFrame, dimension: int, entries: int) -> np.ndarray:
    """``(parts, entries, width)``: the parts of the first vectors of a dimension."""
    rows = vectors.where(is_finite(F.col("embedding")) & (F.size("embedding") == dimension))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    width = -(-dimension // PARTS)
    numbers = np.zeros((len(first), PARTS * width), np.int64)
    numbers[:, :dimension] = floors(np.array([r.embedding for r in first], np.float64).reshape(len(first), dimension), largest_component(dimension))
    return numbers.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()


def lloyd_round(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Assign all parts, then replace each used entry by the floored mean of its parts."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for block in batch.column("parts"):
                for i, stored in enumerate(block.as_py()):
                    points, tree = _part(stored, len(stored["order"]) // 4, width)
                    count, total = sums_of_entries(points, assign(points, tree, codebooks[i]), tree, entries)
                    counts[i] += count
                    totals[i] += total
        i, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(counts[i, k]), pa.array(totals[i, k].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    sums = blocks.select("parts").mapInArrow(run, "part bigint, entry bigint, n bigint, total array<bigint>")
    total = F.array(*[F.sum(F.get("total", F.lit(c))) for c in range(width)]).cast("array<bigint>")
    refined = codebooks.copy()
    for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect():
        refined[row.part, row.entry] = [t // row.n for t in row.total]
    return refined


def train(vectors: DataFrame, blocks: DataFrame, dimension: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``(parts, entries, width)`` of the vectors of one dimension."""
    codebooks = _first_entries(vectors, dimension, entries)
    for _ in range(rounds if dimension else 0):
        codebooks = lloyd_round(blocks, codebooks)
    return codebooks


def encode(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector of the blocks."""
    parts, _, width = codebooks.shape
    ids, labels = blocks.schema["vec_ids"].dataType.elementType, blocks.schema["labels"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                vec_ids, names = batch.column("vec_ids")[row].values, batch.column("labels")[row].values
                n = len(vec_ids)
                codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for i, stored in enumerate(batch.column("parts")[row].as_py()):
                    points, tree = _part(stored, n, width)
                    entries = entry_of_rows(assign(points, tree, codebooks[i]), tree)
                    codes[tree.order, i] = entries
                    error[tree.order] += ((points - codebooks[i][entries]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([vec_ids, names, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = T.StructType().add("vec_id", ids).add("label", labels).add("code", "string").add("error", "long")
    return blocks.select("vec_ids", "labels", "parts").mapInArrow(run, schema)


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (a stored table) with ``label_error``: the sum of ``error`` over equal labels, nulls together.

    Sums are broadcast where their counted rows are few; otherwise every label is joined under
    salts, so that a label of many rows is many tasks.
    """
    sums = materialise(coded.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.count() <= LOOKUP_ROWS:
        return coded.join(F.broadcast(sums), same, "left").drop("of_label")
    salted = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int")
    return coded.withColumn("salt", salt).join(salted, same & (F.col("salt") == F.col("of_salt")), "left").drop("of_label", "salt", "of_salt")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every vector (vec_id, embedding, label)."""
    vectors = vectors.select("vec_id", "embedding", "label")
    blocks = materialise(build_blocks(vectors), "code-blocks")
    found = None
    for dimension in sorted(r.dimension for r in blocks.select("dimension").distinct().collect()):
        mine = blocks.where(F.col("dimension") == dimension)
        codebooks = train(vectors, mine, dimension, entries, rounds)
        coded = encode(mine, codebooks).withColumn("codebooks_sha256", F.lit(digest(codebooks)))
        found = coded if found is None else found.union(coded)
    if found is None:
        found = encode(blocks, np.zeros((PARTS, 0, 0), np.int64)).withColumn("codebooks_sha256", F.lit(""))
    return with_label_errors(materialise(found, "codes"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Lloyd rounds as one chain of common tables, on the parts of all vectors."""
    steps = [r"""
with
v as (select vec_id, label, row_number() over (order by vec_id, embedding) r, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) x
      from embeddings where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
w as (select r, vec_id, label, unnest([0, 1, 2, 3]) part, x, len(x) // 4 k from v),
p as materialized (select r, vec_id, label, part, x[part * k + 1 : part * k + k] x from w),
c0 as materialized (select part, r - 1 entry, x from p where r <= 256)"""]
    for i in range(5):
        steps.append(f"""
a{i} as materialized (select r, part, min(struct_pack(d, entry)) best from (
      select p.r, p.part, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from p join c{i} c using (part)) group by r, part)""")
        if i < 4:
            steps.append(f"""
m{i} as (select part, entry, list(m order by pos) x from (
      select p.part, a.best.entry entry, pos, cast((sum(p.x[pos]) - (sum(p.x[pos]) % count(*) + count(*)) % count(*)) // count(*) as bigint) m
      from p join a{i} a using (r, part), unnest(generate_series(1, len(p.x))) g(pos) group by all) group by all),
c{i + 1} as materialized (select c.part, c.entry, coalesce(m.x, c.x) x from c{i} c left join m{i} m using (part, entry))""")
    steps.append("""
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) codebooks_sha256 from c4),
e as (select r, string_agg(printf('%02x', best.entry), '' order by part) code, cast(sum(best.d) as bigint) error from a4 group by r)
select v.vec_id, e.code, e.error, cast(sum(e.error) over (partition by v.label) as bigint) label_error, h.codebooks_sha256
from v join e using (r), h""")
    return ",".join(steps)


ORACLE_SQL = _oracle()
