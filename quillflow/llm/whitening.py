"""Whitening of embeddings: principal components by contour integration (FEAST).

Entries become integers on a grid, so that sums and products are exact. Two passes over the *fit
list* (each distinct grid vector once) give the sums and then the products of centred vectors; tasks
add up their rows, Spark adds up the tasks, and only sums of the size of the matrix reach the driver.

There the covariance V is reduced to tridiagonal form once. The signs of the pivots of T - s give the
number of eigenvalues below s (inertia). With these counts the interval that holds the wanted
eigenvalues is found and cut into pieces of a few eigenvalues each. For each piece a quadrature of the
resolvent along a circle around it, complex shifted solves of V, projects a block of vectors onto its
eigenspace; Rayleigh-Ritz steps in that space extract eigenpairs until the residuals vanish. A
piece is done when as many were found as its inertia counts say, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import fresh, stored

COMPONENTS = 16
# Grid of the entries: floor(SCALE * entry) + SHIFT. Larger entries than the grid's bound lie on it.
SCALE, SHIFT, BOUND = 64, 1_000_000, 1 << 40
# Eigenvalues below this share of the largest one count as zero.
ZERO = 1e-12
# Points of the quadrature, eigenvalues of a piece that isn't cut further, and rounds of a piece.
POINTS, PIECE, ROUNDS = 16, 6, 60
_INT64 = 1 << 62


class Axes(NamedTuple):
    """Principal components: sums and number of the fit list, eigenvalues, unit vectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = matrix.copy()
    off = np.zeros(max(len(a) - 1, 0))
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        off[k] = -np.copysign(length, v[0])
        v[0] -= off[k]
        v /= np.linalg.norm(v)
        below = a[k + 1:, k + 1:]
        p = below @ v
        w = p - (v @ p) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
    if len(a) > 1:
        off[-1] = a[-1, -2]
    return np.diagonal(a).copy(), off


def count_below(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Eigenvalues of the tridiagonal matrix below ``shift``: its negative pivots."""
    tiny = np.finfo(float).tiny ** 0.5
    below, pivot = 0, 1.0
    for k, entry in enumerate(diagonal.tolist()):
        pivot = entry - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = pivot if abs(pivot) > tiny else -tiny
        below += pivot < 0
    return below


def _contour(matrix: np.ndarray, low: float, high: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in (low, high) by quadrature along the circle around the interval."""
    size = len(matrix)
    scale = max(abs(low), abs(high), np.finfo(float).tiny)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(0.5j * np.pi * (nodes + 1))  # the upper half; the lower one is its conjugate
    width = min(size, 2 * count + 8)
    random = np.random.default_rng(seed)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(3):
        block = random.standard_normal((size, width))
        for _ in range(ROUNDS):
            space = np.zeros((size, width))
            for turn, weight in zip(turns, weights):
                solved = np.linalg.solve((centre + radius * turn) * np.eye(size) - matrix, block)
                space += weight / 2 * (radius * turn * solved).real
            basis, _ = np.linalg.qr(space)
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ small
            inside = np.flatnonzero((values > low) & (values < high))
            if len(inside) < count:
                continue
            residual = np.linalg.norm(matrix @ block - block * values, axis=0)
            chosen = inside[np.argsort(residual[inside])[:count]]
            worst = residual[chosen].max()
            if best is not None and worst >= best[0] / 2 and best[0] < 1e-11 * scale:
                return best[1], best[2]
            if best is None or worst < best[0]:
                best = worst, values[chosen], block[:, chosen]
            if worst < 1e-15 * scale:
                return best[1], best[2]
        if best is not None and best[0] < 1e-9 * scale:
            return best[1], best[2]
        width = min(size, 2 * width)
    raise ArithmeticError(f"found fewer eigenvalues in ({low}, {high}) than the {count} of its inertia")


def leading_pairs(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest positive eigenvalues of a covariance, falling, and their unit vectors."""
    size = len(matrix)
    diagonal, off = tridiagonal(matrix)
    reach = np.abs(diagonal) + np.append(np.abs(off), 0)[:size] + np.insert(np.abs(off), 0, 0)[:size]
    high = float(reach.max(initial=0.0)) * (1 + 1e-9)
    if high <= 0:
        return np.empty(0), np.empty((size, 0))
    above = lambda s: size - count_below(diagonal, off, s)

    def smallest(count: int) -> tuple[float, float]:
        """A narrow bracket of the eigenvalue with ``count - 1`` larger ones."""
        a, b = 0.0, high
        for _ in range(50):
            middle = (a + b) / 2
            a, b = (middle, b) if above(middle) >= count else (a, middle)
        return a, b

    most = min(most, above(ZERO * high))
    if not most:
        return np.empty(0), np.empty((size, 0))
    # The lower end lies in a gap: eigenvalues as good as equal stay together.
    held, (low, _) = most, smallest(most)
    while held < size:
        a, b = smallest(held + 1)
        if low - b > 1e-7 * high or b < ZERO * high / 2:
            low = (low + b) / 2
            break
        held, low = held + 1, a
    else:
        low = -1e-3 * high
    pieces, done = [(low, high)], []
    while pieces:
        a, b = pieces.pop()
        count = above(a) - above(b)
        if count > PIECE and b - a > 1e-6 * high:
            pieces += [(a, (a + b) / 2), ((a + b) / 2, b)]
        elif count:
            done.append((a, b, count))
    vectors = np.hstack([_contour(matrix, a, b, count, k)[1] for k, (a, b, count) in enumerate(done)])
    # One more Rayleigh-Ritz step over all pieces makes close pairs of two pieces orthogonal.
    basis, _ = np.linalg.qr(vectors)
    values, small = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:most]
    vectors = basis @ small[:, order]
    vectors /= np.linalg.norm(vectors, axis=0)
    return values[order], vectors


def grid_vectors(rows: DataFrame, name: str, to: str) -> DataFrame:
    """``rows`` whose vector ``name`` has only finite entries and the usual length, its grid vector in ``to``."""
    entry = lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-BOUND)), F.lit(BOUND)) + SHIFT
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    values = F.transform(F.col(name), lambda c: c.cast("double"))
    good = rows.where(F.col(name).isNotNull() & (F.size(name) > 0) & F.forall(values, finite))
    sizes = good.groupBy(F.size(name).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    (length,) = fresh(rows, "length")
    good = good.withColumn(length, F.size(name)).where(F.col(length) == (sizes["size"] if sizes else 0)).drop(length)
    # A double beyond the longs is cut off before it is rounded.
    inside = lambda c: F.least(F.greatest(c.cast("double"), F.lit(-2.0 * BOUND)), F.lit(2.0 * BOUND))
    return good.withColumn(to, F.transform(F.col(name), lambda c: entry(inside(c))))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(rows: DataFrame, totals) -> dict[int, int]:
    """Exact sums over all batches of ``totals(matrix)``, an array of integers, by place in the array."""
    schema = pa.schema([("place", pa.int32()), ("total", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                part = totals(_matrix(batch.column(0))).astype(object)
                held = part if held is None else held + part
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(held)), pa.int32()), pa.array(list(map(str, held.tolist())))], schema=schema)

    found = rows.mapInArrow(run, "place int, total string").groupBy("place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {row["place"]: int(row["total"]) for row in found.collect()}  # one row per entry of the array


def _products(matrix: np.ndarray) -> np.ndarray:
    """Upper triangle of the products of all columns, exact."""
    most = int(np.abs(matrix).max(initial=0))
    if most * most * len(matrix) < 1 << 52:  # exact in doubles, whose products are much faster
        product = np.rint(matrix.T.astype(float) @ matrix.astype(float)).astype(np.int64)
    else:
        product = matrix.astype(object).T @ matrix.astype(object) if most * most * len(matrix) >= _INT64 else matrix.T @ matrix
    return product[np.triu_indices(matrix.shape[1])]


def fit_axes(vectors: DataFrame, most: int = COMPONENTS) -> Axes | None:
    """Components of the distinct rows of ``vectors`` (one column of grid vectors of one length); None without rows."""
    sums = _added(vectors, lambda m: np.append(m.sum(axis=0), len(m)))
    if not sums:
        return None
    size = len(sums) - 1
    n, totals = sums[size], [sums[i] for i in range(size)]
    middle = np.array([t // n for t in totals])
    products = _added(vectors, lambda m: _products(m - middle))
    rest = [t % n for t in totals]  # sum of x - middle
    covariance = np.zeros((size, size))
    for place, (i, j) in enumerate(zip(*np.triu_indices(size))):
        # Exact up to the last division: n * sum(y_i y_j) - sum(y_i) sum(y_j).
        covariance[i, j] = covariance[j, i] = (n * products[place] - rest[i] * rest[j]) / (n * n)
    values, axes = leading_pairs(covariance, most)
    return Axes(n, totals, values, axes, float(np.trace(covariance)))


def _centred(matrix: np.ndarray, axes: Axes) -> np.ndarray:
    """x - S / n, the whole part of S / n taken off before rounding."""
    middle = np.array([t // axes.n for t in axes.sums])
    return (matrix - middle) - np.array([t % axes.n for t in axes.sums]) / axes.n


def identity_error(vectors: DataFrame, axes: Axes) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured over all of it."""
    size = len(axes.values)
    weights = axes.vectors / np.sqrt(axes.values)

    def run(batches):
        held = np.zeros((size, size + 1))
        for batch in batches:
            white = _centred(_matrix(batch.column(0)), axes) @ weights
            held += np.hstack([white.T @ white, white.sum(axis=0)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(held.size), pa.int32()), pa.array(held.ravel())],
                                         names=["place", "total"])

    rows = vectors.mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    held = np.zeros(size * (size + 1))
    for row in rows:
        held[row["place"]] = row["total"]
    held = held.reshape(size, size + 1) / axes.n
    centre = held[:, -1]
    return float(np.abs(held[:, :-1] - np.outer(centre, centre) - np.eye(size)).max(initial=0.0))


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row of ``rows`` (vec_id, embedding), one row per component.

    vec_id, component (from 1, by falling eigenvalue), n (distinct grid vectors), deviation (sum of
    (n x - S)^2, exact; null where it doesn't fit into a long), whitened, explained (share of the
    trace), identity_error. Rows whose vector is null or empty, holds a null or a non-finite entry, or
    hasn't the length that most rows have (of equally frequent lengths the larger) are left out.
    Entries beyond 2**34 count as 2**34. Repeated rows give repeated results but count once
    in the fit. Directions without variance are no components, so one distinct vector or an empty
    table gives an empty result. Other columns are ignored.
    """
    spark = rows.sparkSession
    fields = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    grid = stored(grid_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"),
                               "embedding", "x").select("vec_id", "x"), "grid")
    distinct = stored(grid.select("x").distinct(), "fit")
    axes = fit_axes(distinct, most)
    if axes is None or not len(axes.values):
        return spark.createDataFrame([], fields)
    error = identity_error(distinct, axes)
    weights, count = axes.vectors / np.sqrt(axes.values), len(axes.values)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def deviations(matrix: np.ndarray) -> list[int | None]:
        most = axes.n * (int(np.abs(matrix).max(initial=0)) + max(abs(t) // axes.n for t in axes.sums) + 1)
        if most < _INT64 and (matrix.shape[1] * (bound := int(np.abs(
                matrix * axes.n - np.array(axes.sums)).max(initial=0))) * bound) < _INT64:
            return ((matrix * axes.n - np.array(axes.sums)) ** 2).sum(axis=1).tolist()
        exact = ((matrix.astype(object) * axes.n - np.array(axes.sums, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact.tolist()]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column(1))
            white = _centred(matrix, axes) @ weights
            each = len(matrix)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(each), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), each)),
                pa.array(np.full(each * count, axes.n)),
                pa.array([v for v in deviations(matrix) for _ in range(count)], pa.int64()),
                pa.array(white.ravel()), pa.array(np.tile(axes.values / axes.trace, each)),
                pa.array(np.full(each * count, error))], schema=schema)

    return grid.mapInArrow(run, fields)
