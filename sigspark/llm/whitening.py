"""Embedding whitening by contour integration (operator 13).

The covariance is one pass over the vectors: exact integer sums per task, added up by an aggregate. Its eigenpairs come from FEAST:
for an interval of the spectrum a rational filter, the quadrature of the resolvent along a circle through the interval's ends,
projects a block of vectors onto the wanted eigenvectors by complex shifted solves; Rayleigh-Ritz extracts eigenpairs from the
projected block, and both repeat until residuals are at rounding level. Intervals are chosen by inertia counts: the signs of
the pivots of V - s I tell how many eigenvalues lie above s, so a spectrum is cut into intervals of few eigenvalues, and each
interval must yield exactly as many pairs as its counts say. The matrix has one row per dimension, whatever the rows; the
projection of the vectors is again one pass.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, settle

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000                        # how entries become integers
NODES = 8                                           # quadrature points on the half circle
INTERVAL = 8                                        # eigenvalues of an interval, unless they lie too close to be cut apart
ROUNDS = 30
CLOSE = 1e-11                                       # eigenvalues nearer than this share of the largest are not cut apart
TINY = 1e-12                                        # components below this share of the trace are no directions of the data
LARGEST = 2.0 ** 46                                 # entries beyond are no embeddings; their squares would not be exact


def tridiagonal(matrix: np.ndarray) -> tuple[list[float], list[float]]:
    """Diagonal and neighbours of a tridiagonal matrix with the same eigenvalues, by Householder reflections."""
    a = matrix.astype(float).copy()
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        length = np.linalg.norm(v)
        if length > 0:
            v /= length
            a[k + 1:] -= 2 * np.outer(v, v @ a[k + 1:])
            a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ v, v)
    return np.diag(a).tolist(), np.diag(a, -1).tolist()


def above(bands: tuple[list[float], list[float]], shift: float) -> int:
    """Inertia: how many eigenvalues are larger than ``shift``, the positive pivots of the matrix less shift on its diagonal."""
    positive, pivot = 0, 1.0
    for a, b in zip(bands[0], [0.0, *bands[1]]):
        pivot = a - shift - (b * b / pivot if b else 0.0)
        if pivot == 0:
            pivot = -np.finfo(float).tiny ** 0.5
        positive += pivot > 0
    return positive


def cut_spectrum(matrix: np.ndarray, wanted: int, at_most: int = INTERVAL) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues), from above, that together hold at least the ``wanted`` largest eigenvalues; found by bisection on inertia counts."""
    bound = float(np.abs(matrix).sum(axis=1).max()) * 1.001 + np.finfo(float).tiny
    bands, top, found, intervals = tridiagonal(matrix), bound, 0, []
    free = lambda s: above(bands, s - CLOSE * bound) == above(bands, s + CLOSE * bound)
    while found < min(wanted, len(matrix)):
        largest, below = top, -bound                                # of those left: within a thousandth
        while largest - below > max(1e-3 * abs(largest), CLOSE * bound):
            middle = (largest + below) / 2
            largest, below = (largest, middle) if above(bands, middle) > found else (middle, below)
        low, high, cut = -bound, top, None                          # `low` has too many eigenvalues above it, `high` too few
        if largest > 4 * CLOSE * bound and 0 < above(bands, largest / 4) - found <= at_most and free(largest / 4):
            cut = largest / 4                                       # a wider interval would hide its small eigenvalues at its edge
        while cut is None and high - low > CLOSE * bound:
            middle = (low + high) / 2
            n = above(bands, middle) - found
            if n > at_most:
                low = middle
            elif n > min(at_most, wanted - found) // 2 and free(middle):
                cut = middle
            else:
                high = middle
        step = 4 * CLOSE * bound
        while cut is None:                                          # a cluster that no cut divides is taken whole
            cut, low, step = (low if free(low) else None), low - step, 2 * step
        high, n = cut, above(bands, cut) - found
        gap = _gap(bands, high, top, found + n, bound)
        intervals.append((gap, min(top, largest + abs(largest) / 8 + CLOSE * bound), n))
        top, found = gap, found + n
    return intervals


def _gap(bands: tuple[list[float], list[float]], low: float, top: float, count: int, bound: float) -> float:
    """A cut with ``count`` eigenvalues above it, moved to the middle of the gap it lies in, so that no eigenvalue is at the interval's edge."""
    inner, outer = (low, top), (-bound, low)
    for _ in range(50):
        middle = sum(inner) / 2
        inner = (middle, inner[1]) if above(bands, middle) == count else (inner[0], middle)
        if inner[1] - inner[0] < bound * CLOSE or inner[1] - inner[0] < 0.01 * (inner[0] - outer[1]):
            break
    for _ in range(50):
        middle = sum(outer) / 2
        outer = (outer[0], middle) if above(bands, middle) == count else (middle, outer[1])
        if outer[1] - outer[0] < bound * CLOSE or outer[1] - outer[0] < 0.01 * (inner[0] - outer[1]):
            break
    return (inner[0] + outer[1]) / 2


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs inside (low, high), by falling eigenvalue. An error tells if they are not all found."""
    size, scale = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = np.exp(1j * np.pi / 2 * (1 - points))                   # the upper half circle; the lower one gives the conjugate
    block = np.random.default_rng(seed).standard_normal((size, min(size, max(count + 4, count * 3 // 2))))
    for round_ in range(ROUNDS):
        if round_ % 6 == 5 and block.shape[1] < size:               # what lies just outside needs room in the block too
            block = np.hstack((block, np.random.default_rng(seed + round_).standard_normal((size, min(size - block.shape[1], block.shape[1])))))
        block, _ = np.linalg.qr(block)
        filtered = np.zeros_like(block)
        for turn, weight in zip(turns, weights):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(size) - matrix, block.astype(complex))
            filtered += (weight / 2) * (radius * turn * solved).real
        basis, _ = np.linalg.qr(filtered)
        small = basis.T @ matrix @ basis
        values, vectors = np.linalg.eigh((small + small.T) / 2)     # Rayleigh-Ritz
        block = basis @ vectors
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0)
        if inside.sum() == count and (not count or residual.max() <= 200 * np.finfo(float).eps * scale):
            order = np.argsort(-values[inside])
            return values[inside][order], block[:, inside][:, order]
    raise ArithmeticError(f"{int(inside.sum())} of {count} eigenpairs between {low} and {high} after {ROUNDS} rounds")


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and orthonormal eigenvectors as columns."""
    wanted = min(wanted, len(matrix))
    pairs = [feast(matrix, low, high, n) for low, high, n in cut_spectrum(matrix, wanted) if n]
    values, vectors = np.concatenate([v for v, _ in pairs]), np.concatenate([u for _, u in pairs], axis=1)
    vectors, _ = np.linalg.qr(vectors)                              # intervals meet at rounding level only
    return values[:wanted], vectors[:, :wanted]


def usable(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole: no null, no null or non-finite entry, the most frequent length."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST))
    whole = (embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("c")).where(F.col("c").isNotNull() & F.forall("c", entry))
             .withColumn("x", F.transform("c", lambda c: F.floor(c * scale).cast("long") + shift)))
    lengths = whole.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).where("size > 0")
    size = lengths.orderBy(F.desc("n"), "size").first()
    return whole.where(F.size("x") == (size["size"] if size else -1)).select("vec_id", "x")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _added(parts: DataFrame, column: str) -> np.ndarray:
    """Sum of an array column over all rows, place by place; only the sums reach the driver."""
    cells = parts.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in cells.orderBy("at").collect()])


def fitted(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, sums per dimension, covariance with divisor n) of ``vectors`` (x).

    Vectors are centred on the whole number next to the mean, which keeps products of integers exact in a task, and the
    covariance is moved by what is left, at most a half.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), pa.array([_matrix(batch["x"]).sum(axis=0)], pa.list_(pa.int64()))], names=["n", "s"])
    parts = vectors.select("x").mapInArrow(sums, "n long, s array<long>")
    rows = (parts.select("n", F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("at").collect())     # one row per dimension
    if not rows:
        return 0, [], np.zeros((0, 0))
    n, total = rows[0]["n"], [int(r["v"]) for r in rows]
    middle = np.array([(2 * s + n) // (2 * n) for s in total])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                y = (_matrix(batch["x"]) - middle).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([(y.T @ y).ravel()], pa.list_(pa.float64()))], names=["g"])
    gram = _added(vectors.select("x").mapInArrow(products, "g array<double>"), "g").reshape(len(total), -1)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(total, middle)])
    return n, total, gram / n - np.outer(rest, rest)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) per usable row and component.

    Entries become x = floor(scale * c) + shift. n counts the usable rows, deviation is the sum over dimensions of
    (n * x - S)^2 (null where it passes 64 bits; deviation_exact is a decimal and null only past 38 digits), whitened the
    centred vector's projection on a component over the root of its eigenvalue, explained the eigenvalue's share of the trace, identity_error the
    largest entry of the whitened rows' covariance minus the identity. Components are numbered by falling eigenvalue; those
    below TINY of the trace, as of constant dimensions, have no rows, and equal vectors alone give no rows at all. Rows with a
    null vector, a null, non-finite or huge (LARGEST) entry, or another length than most are left out; null and repeated
    vec_ids and repeated rows stay; an empty table gives none; further columns are ignored.
    """
    vectors = settle(usable(embeddings, scale, shift))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    n, total, covariance = fitted(vectors)
    trace = float(np.trace(covariance))
    if trace <= 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    values, directions = leading(covariance, min(components, above(tridiagonal(covariance), TINY * trace)))
    scaled, explained = directions / np.sqrt(values), values / trace
    middle = np.array([(2 * s + n) // (2 * n) for s in total])
    left = np.array([s - n * int(m) for s, m in zip(total, middle)], dtype=object)      # n x - S = n (x - middle) - left
    rest = np.array([int(v) / n for v in left])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = [int(v) for v in left]
        for batch in batches:
            if not len(batch):
                continue
            moved = _matrix(batch["x"]) - middle
            largest = int(np.abs(moved).max()) * n + max(map(abs, wide))
            if len(wide) * largest ** 2 < 1 << 63:
                off = moved * n - np.array(wide, np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                deviation = [sum((n * v - w) ** 2 for v, w in zip(row, wide)) for row in moved.tolist()]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(list((moved - rest) @ scaled), pa.list_(pa.float64())), pa.array([str(d) if d < 10 ** 38 else None for d in deviation], pa.string())], names=["vec_id", "w", "d"])

    projected = settle(vectors.select(F.col("vec_id").cast("long"), "x").mapInArrow(project, "vec_id long, w array<double>, d string"))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                w = _matrix(batch["w"])
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))], pa.list_(pa.float64()))], names=["g"])
    sums = _added(projected.select("w").mapInArrow(squares, "g array<double>"), "g")
    mean, k = sums[:len(values)] / n, len(values)
    error = float(np.abs(sums[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    share = F.array(*[F.lit(float(e)) for e in explained])
    exact = F.col("d").cast("decimal(38,0)")
    return (projected.select("vec_id", F.posexplode("w").alias("at", "whitened"), exact.alias("deviation_exact"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.when(F.col("deviation_exact") < F.lit(1 << 62).cast("decimal(38,0)") * 2, F.col("deviation_exact")).cast("long").alias("deviation"), "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))
