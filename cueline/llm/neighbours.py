"""Nearest neighbours by cosine over randomly rotated one-bit codes.

A unit vector is rotated by a fixed random rotation and only the signs of its
coordinates are kept, packed to bits. With the correction scalar ``f`` (the inner
product of the rotated vector with its own sign code, scaled to a unit vector)
``<code, query> / f`` estimates the cosine, and its error is within
``sqrt(1 - f^2) / f * width / sqrt(d - 1)`` with a probability set by ``width``.
A vector whose estimate plus bound stays below the k-th best cosine so far can't
be among the nearest; all others are reranked on the original vectors.

The rotation depends on the dimension and a seed alone, so nothing is fitted.
Every row is indexed. Queries go in blocks of a bounded size against all rows;
each partition returns its k best per query.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without ``vec_id``. Vectors meet those of
their own dimension. Rows with the query's ``vec_id`` are its own. A repeated
``vec_id`` is listed once with its best score, and is one query (of its smallest
vector that takes part). An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline.llm.tables import read
from cueline.llm.vectors import is_finite
from cueline.session import materialise

NEAREST = 5
SEED = 17
#: Bounds hold for all but about 2 * exp(-WIDTH ** 2 / 2) of the pairs.
WIDTH = 3.5
#: Queries of a block, on average; one block is in memory at a time.
QUERY_BLOCK = 2048
#: Candidates estimated at once, and pairs reranked at once.
_ROWS, _PAIRS = 4096, 1 << 16


@cache
def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of ``dimension`` coordinates."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dimension]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors that take part, for each dimension."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dimension in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dimension)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        matrix = flat.reshape(len(rows), dimension)  # null components are NaN
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        if good.any():
            yield rows[good], matrix[good]


def _units(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def encode(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of the rows of ``matrix``."""
    rotated = _units(matrix) @ rotation(matrix.shape[1]).T
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(matrix.shape[1])


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision."""
    dot = np.einsum("ij,ij->i", left, right)
    return dot / (np.sqrt(np.einsum("ij,ij->i", left, left)) * np.sqrt(np.einsum("ij,ij->i", right, right)))


def build_index(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, code, correction`` of every vector that takes part."""
    schema = vectors.select("vec_id", "embedding").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _vectors(batch.column("embedding")):
                code, correction = encode(matrix)
                kept = batch.select(["vec_id", "embedding"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(correction)], names=["vec_id", "embedding", "code", "correction"])

    return vectors.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(run, schema.add("code", "binary").add("correction", "double"))


class _Best:
    """The k nearest so far of each query of one dimension."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k, dimension = ids, matrix, k, matrix.shape[1]
        self.rotated = (_units(matrix) @ rotation(dimension).T).astype(np.float32)
        self.level = np.full(len(ids), -np.inf)
        #: Query, score and vec_id of what is nearest so far.
        self.queries, self.scores, self.names = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, matrix: np.ndarray, code: np.ndarray, f: np.ndarray) -> None:
        dimension = matrix.shape[1]
        signs = np.unpackbits(code, axis=1, count=dimension).astype(np.float32) * 2 - 1
        estimate = (signs @ self.rotated.T) / (f * np.sqrt(dimension))[:, None].astype(np.float32)
        bound = np.sqrt(np.maximum(1 - f * f, 0)) / f * WIDTH / np.sqrt(max(dimension - 1, 1)) + 1e-6
        if not np.isfinite(self.level).all():  # a first level from the best estimates
            best = np.argpartition(-estimate, min(2 * self.k, len(ids) - 1), axis=0)[: 2 * self.k]
            self._rerank(best.ravel(), np.tile(np.arange(len(self.ids)), len(best)), ids, matrix)
        rows, queries = np.nonzero(estimate + bound[:, None] >= self.level)
        for first in range(0, len(rows), _PAIRS):
            self._rerank(rows[first : first + _PAIRS], queries[first : first + _PAIRS], ids, matrix)

    def _rerank(self, rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        other = ids[rows] != self.ids[queries]
        rows, queries = rows[other], queries[other]
        q = np.concatenate([self.queries, queries])
        s = np.concatenate([self.scores, cosines(self.matrix[queries], matrix[rows])])
        names = np.concatenate([self.names, ids[rows]])
        order = np.lexsort((-s, names, q))
        q, s, names = q[order], s[order], names[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (names[1:] != names[:-1])
        order = np.lexsort((names[once], -s[once], q[once]))
        q, s, names = q[once][order], s[once][order], names[once][order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept, last = place < self.k, place == self.k - 1
        self.queries, self.scores, self.names = q[kept], s[kept], names[kept]
        self.level[q[last]] = s[last]


def _takes_part(vector: Column) -> Column:
    """Whether a vector is finite and not zero; null, empty and unusable ones are left out before ids are folded."""
    return is_finite(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def search(index: DataFrame, queries: DataFrame, k: int = NEAREST, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``index`` to each query (vec_id, embedding)."""
    queries = queries.where(F.col("vec_id").isNotNull() & _takes_part(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-queries.count() // block))
    found = None
    for number in range(blocks):
        table = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
        near = index.mapInArrow(_searcher(table, k), "query_id bigint, vec_id bigint, score double")
        found = near if found is None else found.union(near)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(queries: pa.Table, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, names = queries.column("embedding").combine_chunks(), queries.column("vec_id").to_numpy()
        best = {m.shape[1]: _Best(names[rows], m, k) for rows, m in _vectors(column)}
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                ids, f = part.column("vec_id").to_numpy(), part.column("correction").to_numpy()
                for rows, matrix in _vectors(part.column("embedding")):
                    if matrix.shape[1] in best:
                        code = np.frombuffer(b"".join(part.column("code").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                        best[matrix.shape[1]].add(ids[rows], matrix, code, f[rows])
        for state in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(state.ids[state.queries]), pa.array(state.names), pa.array(state.scores)], names=["query_id", "vec_id", "score"])

    return run


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(materialise(build_index(vectors), "vector-codes"), vectors.where("vec_id % 50 = 0"))
