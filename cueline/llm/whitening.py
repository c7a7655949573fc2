"""Whitening of embeddings by a bidiagonal qd solver.

Every component ``c`` becomes the long ``x = floor(1024 * c) + 100000``.

1. Sums per dimension: exact, one row per task and dimension.
2. *Blockwise QR*: every task reduces its centred rows to one triangle, triangles are
   reduced in groups of a fixed size until one is left. No covariance is ever formed, so
   small components keep their accuracy.
3. On the driver, on that one triangle: *Householder* reflections make it bidiagonal,
   *dqds* finds the singular values (every entry of the qd array to high relative accuracy), and
   *twisted factorisations* give the directions. Near values are told apart by inverse iteration
   against the ones found before.
4. Every task projects its centred rows on the directions, and sums their moments.

Rows are centred as ``(x - S div n) - (S mod n) / n``, which loses no digits to the
offset.

Defined results: vectors that are null or hold null or non-finite components are dropped; rows
with equal or no ``vec_id`` are kept each. Vectors of different dimensions are whitened apart.
Components whose variance is zero (to rounding) do not exist: a dimension of one vector, or of equal
vectors, gives no rows. Components of equal variance are any orthonormal choice. The entry of a
direction that is largest in magnitude is positive. ``deviation`` is null where it exceeds a long; numbers
beyond 2^40 are cut to that. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.tables import read
from cueline.llm.vectors import finite_vectors, floors
from cueline.session import materialise

COMPONENTS = 8
OFFSET = 100_000
#: Bytes of triangles that one reduction holds, on average.
REDUCE_BYTES = 64 << 20
_BOUND = 1 << 40
_EPS = np.finfo(np.float64).eps


# ---- one triangle: bidiagonal form, singular values, directions ----


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of ``U' r V`` and the reflectors of ``V``."""
    a, reflectors = np.array(r, np.float64), []
    n = len(a)

    def reflector(x: np.ndarray) -> np.ndarray:
        u = x.copy()
        scale = np.abs(u).max(initial=0)
        if scale == 0:
            return u
        u /= scale
        u[0] += math.copysign(np.sqrt(u @ u), u[0])
        return u / np.sqrt(u @ u)

    for k in range(n):
        u = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        v = np.zeros(n)
        if k < n - 2:
            v[k + 1 :] = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v[k + 1 :], v[k + 1 :])
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def _qd(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd transform with ``shift``; None if the shift was above the least eigenvalue."""
    d, qs, es, ds = q[0] - shift, [], [], []
    for k in range(len(e)):
        if d < 0:
            return None
        ds.append(d)
        above = d + e[k]
        ratio = q[k + 1] / above if above else math.inf
        qs.append(above)
        es.append(e[k] * ratio if e[k] else 0.0)
        d = (d * ratio if d else 0.0) - shift
    if d < 0 or d != d:
        return None
    ds.append(d)
    qs.append(d)
    return qs, es, ds


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, falling.

    Each step first makes a transform without shift, whose ``d`` bound the least eigenvalue from below
    (``1 / sum(1 / d)``) and above (``min(d)``); a bold shift from the last pair is tried, then the safe one.
    """
    norm = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if norm == 0:
        return np.zeros(len(a))
    q = [max(float(x / norm) ** 2, 1e-60) for x in a]
    e = [float(x / norm) ** 2 for x in b]
    done, runs = [], [(q, e, 0.0)]
    tiny = (4 * _EPS) ** 2
    while runs:
        q, e, moved = runs.pop()
        while q:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= tiny * (moved + min(q[k], q[k + 1]))), None)
            if cut == len(e) - 1 or not e:  # the last value stands alone
                done.append(moved + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            if cut is not None:
                runs.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:  # small values are found fastest at the end
                q, e = q[::-1], e[::-1]  # the flipped, transposed factor has the same values
            q, e, d = _qd(q, e, 0.0)
            low = min(d)
            safe = 1 / sum(1 / x for x in d) if low > 0 else 0.0
            p, s = q[-2] + e[-1], q[-1]
            half = (p + e[-2] if len(e) > 1 else p) - s
            bold = s - e[-1] * s / (half + e[-1]) if half > 0 else 0.0
            for shift in (min(bold, low) * (1 - 1e-3), safe * (1 - 8 * len(q) * _EPS)):
                if shift > safe / 2 and (moved + shift > moved) and (stepped := _qd(q, e, shift)) is not None:
                    q, e, _ = stepped
                    moved += shift
                    break
    return np.sort(np.array(done))[::-1] * norm * norm


def _representation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``D`` and ``l`` of ``B'B = L D L'``."""
    return a * a, b / a[:-1]


def _factors(d: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stationary factor ``l+, d+`` from the top, progressive ``u-`` from the bottom, and the twists ``gamma``."""
    n, least = len(d), _EPS * _EPS * max(value, 1e-300)
    plus, pivot, s, lower = np.empty(max(n - 1, 0)), np.empty(n), np.empty(n), -value
    for k in range(n):
        s[k] = lower
        pivot[k] = d[k] + lower
        if abs(pivot[k]) < least:
            pivot[k] = -least
        if k < n - 1:
            plus[k] = d[k] * l[k] / pivot[k]
            lower = plus[k] * l[k] * lower - value
    minus, p, upper = np.empty(max(n - 1, 0)), np.empty(n), d[-1] - value
    p[-1] = upper
    for k in range(n - 2, -1, -1):
        below = d[k] * l[k] * l[k] + upper
        if abs(below) < least:
            below = -least
        ratio = d[k] / below
        minus[k] = l[k] * ratio
        upper = upper * ratio - value
        p[k] = upper
    return plus, pivot, minus, s + p + value


def twisted_vector(d: np.ndarray, l: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of ``L D L'`` at ``value``, from the twist of least ``gamma``."""
    plus, _, minus, gamma = _factors(d, l, value)
    twist = int(np.argmin(np.abs(gamma)))
    z = np.zeros(len(d))
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -plus[k] * z[k + 1]
    for k in range(twist, len(d) - 1):
        z[k + 1] = -minus[k] * z[k]
    scale = np.abs(z).max()
    z /= scale
    return z / np.sqrt(z @ z)


def _solve(d: np.ndarray, l: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """A solution of ``(L D L' - value) z = right`` from the stationary factors."""
    plus, pivot, _, _ = _factors(d, l, value)
    z = right.copy()
    for k in range(len(d) - 1):
        z[k + 1] -= plus[k] * z[k]
    z /= pivot
    for k in range(len(d) - 2, -1, -1):
        z[k] -= plus[k] * z[k + 1]
    scale = np.abs(z).max()
    return z / scale if np.isfinite(scale) and scale > 0 else right


class Whitening(NamedTuple):
    """Variances, share of the trace, and the directions as columns."""

    variances: np.ndarray
    explained: np.ndarray
    directions: np.ndarray


def solve(r: np.ndarray, n: int, components: int = COMPONENTS) -> Whitening:
    """Whitening directions of ``n`` centred rows whose triangle is ``r``."""
    a, b, reflectors = bidiagonalise(r)
    norm = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if norm == 0:
        return Whitening(np.zeros(0), np.zeros(0), np.zeros((len(a), 0)))
    squares = dqds(a, b)
    squares = squares[: min(components, n - 1)]
    squares = squares[squares > (len(a) * _EPS) ** 2 * squares.max(initial=0)]
    a = np.where(np.abs(a) < norm * 1e-30, norm * 1e-30, a)
    d, l = _representation(a, b)
    found, random = [], np.random.default_rng(7)
    for value in squares.tolist():
        z = twisted_vector(d, l, value)
        near = [u for u, other in zip(found, squares) if other - value <= 1e-3 * value]
        if near:
            basis = np.stack(near, axis=1)
            rest = z - basis @ (basis.T @ z)
            if rest @ rest < 0.25:  # the twist found an earlier direction again
                rest = random.standard_normal(len(z))
            for _ in range(6):
                rest -= basis @ (basis.T @ rest)
                rest /= np.sqrt(rest @ rest)
                rest = _solve(d, l, value * (1 + 2 * _EPS), rest)
                rest -= basis @ (basis.T @ rest)
                rest -= basis @ (basis.T @ rest)
                rest /= np.sqrt(rest @ rest)
            z = rest
        found.append(z)
    directions = np.stack(found, axis=1) if found else np.zeros((len(a), 0))
    for v in reversed(reflectors):
        directions = directions - 2 * np.outer(v, v @ directions)
    if directions.size:
        largest = directions[np.argmax(np.abs(directions), axis=0), np.arange(directions.shape[1])]
        directions = directions * np.sign(largest)
    return Whitening(squares / n, squares / np.sum(r * r) if len(squares) else squares, directions)


# ---- Spark: sums, triangles, projections ----


class Centre(NamedTuple):
    """Number of vectors and the sums of their components."""

    n: int
    sums: list[int]

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole and fractional part of the means."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n / self.n for s in self.sums])


def numbers(matrix: np.ndarray) -> np.ndarray:
    return floors(matrix, _BOUND) + OFFSET


def centres(vectors: DataFrame) -> dict[int, Centre]:
    """Number and sums of the vectors of each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = {}, {}
        for batch in batches:
            for rows, matrix in finite_vectors(batch.column("embedding")):
                dimension = matrix.shape[1]
                counts[dimension] = counts.get(dimension, 0) + len(rows)
                sums[dimension] = sums.get(dimension, 0) + numbers(matrix).sum(axis=0).astype(object)
        for dimension, total in sums.items():
            yield pa.RecordBatch.from_pydict({"dimension": [dimension] * dimension, "place": list(range(dimension)), "n": [counts[dimension]] * dimension, "total": [str(t) for t in total]}, pa.schema([("dimension", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))

    partial = vectors.select("embedding").mapInArrow(run, "dimension int, place int, n bigint, total string")
    rows = partial.groupBy("dimension", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dimension", "place").collect()
    found: dict[int, Centre] = {}
    for r in rows:
        found.setdefault(r.dimension, Centre(r.n, [])).sums.append(int(r.total))
    return found


def triangle(rows: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    """The square triangle of ``rows`` below the triangle ``above``; short ones get rows of zeros."""
    width = rows.shape[1]
    stacked = rows if above is None else np.vstack([above, rows])
    r = np.linalg.qr(stacked, mode="r")
    return r if len(r) == width else np.vstack([r, np.zeros((width - len(r), width))])


def reduce_rows(vectors: DataFrame, dimension: int, centre: Centre) -> np.ndarray:
    """The triangle of all centred rows of a dimension, by a tree of QR reductions."""
    whole, part = centre.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for _, matrix in finite_vectors(batch.column("embedding")):
                if matrix.shape[1] == dimension:
                    r = triangle((numbers(matrix) - whole) - part, r)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_part, r = None, None
        for batch in batches:
            for number, stored in zip(batch.column("part").to_pylist(), batch.column("r").to_pylist()):
                rows = np.frombuffer(stored, np.float64).reshape(dimension, dimension)
                if number != open_part and r is not None:
                    yield _triangle_row(open_part, r)
                    r = None
                open_part, r = number, triangle(rows, r)
        if r is not None:
            yield _triangle_row(open_part, r)

    parts = vectors.rdd.getNumPartitions()
    fan_in = max(2, min(64, REDUCE_BYTES // max(8 * dimension * dimension, 1)))
    found = vectors.select("embedding").mapInArrow(run, "part bigint, r binary")
    while parts > 1:
        parts = -(-parts // fan_in)
        group = (F.col("part") / fan_in).cast("bigint")
        # a triangle is one row; those of a group follow each other and are reduced one by one
        found = found.select(group.alias("part"), "r").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(join, "part bigint, r binary")
    rows = found.collect()
    return np.frombuffer(bytes(rows[0].r), np.float64).reshape(dimension, dimension)


def _triangle_row(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])


def deviations(centred: np.ndarray, n: int, remainders: np.ndarray) -> list[int | None]:
    """``sum((n * x - S) ** 2)`` of each row, exactly; None above a long. ``centred`` is ``x - S div n``."""
    estimate = ((n * centred.astype(np.float64) - remainders) ** 2).sum(axis=1)
    safe = estimate < 2.0**62
    found: list[int | None] = [None] * len(centred)
    steps = n * centred[safe] - remainders
    for row, total in zip(np.flatnonzero(safe), (steps * steps).sum(axis=1).tolist()):
        found[row] = total
    for row in np.flatnonzero(~safe & (estimate < 2.0**64)):
        total = sum((n * int(x) - int(s)) ** 2 for x, s in zip(centred[row], remainders))
        found[row] = total if total < 2**63 else None
    return found


def project(vectors: DataFrame, dimension: int, centre: Centre, whitening: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` (array) of every vector of a dimension."""
    whole, part = centre.split()
    remainders = np.array([s % centre.n for s in centre.sums], np.int64)
    axes = whitening.directions / np.sqrt(whitening.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in finite_vectors(batch.column("embedding")):
                if matrix.shape[1] == dimension:
                    centred = numbers(matrix) - whole
                    white = (centred - part) @ axes
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(pa.array(rows)), pa.array(deviations(centred, centre.n, remainders), pa.int64()), pa.array(white.tolist(), pa.list_(pa.float64()))],
                        names=["vec_id", "deviation", "whitened"],
                    )

    schema = T.StructType().add("vec_id", vectors.schema["vec_id"].dataType).add("deviation", "long").add("whitened", T.ArrayType(T.DoubleType()))
    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def identity_error(projected: DataFrame, n: int, components: int) -> float:
    """Largest entry by which the covariance of the stored whitened rows differs from the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            rows = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            sums += rows.sum(axis=0)
            products += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([sums, products.ravel()]).tolist()], pa.list_(pa.float64()))], names=["moments"])

    size = components + components * components
    parts = projected.select("whitened").mapInArrow(run, "moments array<double>")
    row = np.array(parts.agg(*[F.sum(F.get("moments", F.lit(i))) for i in range(size)]).first(), np.float64)
    mean, products = row[:components] / n, row[components:].reshape(components, components) / n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(components)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector (vec_id, embedding)."""
    vectors = vectors.select("vec_id", "embedding")
    found = None
    for dimension, centre in centres(vectors).items():
        whitening = solve(reduce_rows(vectors, dimension, centre), centre.n, components)
        if not len(whitening.variances):
            continue
        projected = materialise(project(vectors, dimension, centre, whitening), "whitened")
        explained = F.array(*[F.lit(float(x)) for x in whitening.explained])
        rows = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
            "vec_id", (F.col("place") + 1).alias("component"), F.lit(centre.n).cast("bigint").alias("n"), "deviation", "whitened",
            F.get(explained, F.col("place")).alias("explained"), F.lit(identity_error(projected, centre.n, len(whitening.variances))).alias("identity_error"),
        )
        found = rows if found is None else found.union(rows)
    if found is not None:
        return found
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
