"""Embedding whitening: pivoted Cholesky, then one-sided Jacobi on the factor.

Vectors become whole numbers, x = floor(256 * c); the fit list is each distinct
x vector once, so copies do not weigh.  Its size and sums are exact.  Tasks
centre before they multiply and add up partial scatter matrices; these travel as
rows of the matrix and are summed per row in two rounds, the first salted.  The
covariance V, dimensions squared, is all that the driver holds.

V is factored by Cholesky with complete pivoting; one-sided Jacobi rotates the
columns of the triangular factor L itself (V = L L') until they are orthogonal.
Their squared norms then are V's eigenvalues, the normalised columns its
eigenvectors: V's small eigenvalues keep their relative precision, which a
product of L would lose.

Defined results: rows whose vector is null, empty, of another length than the
commonest (ties: the longer), or holds a null or non-finite entry take no part;
zero vectors and rows with equal or null vec_id do; x beyond 2**62 saturates there.
There are as many components as V has rank, so none where all vectors are equal.
A component's largest entry (ties: the first) is positive.  Extra columns are
ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skupulse.llm.common import cut, frugal

SCALE = 256
SALTS = 32               # first round of the scatter's sum
TOP = 2.0 ** 62


# ---- factorisation

def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower trapezoidal factor T and the order of rows with matrix[order][:, order]
    = T T', the largest remaining diagonal first; as many columns as the rank."""
    a = np.array(matrix, np.float64)
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    left = a.diagonal().copy()
    least = d * np.finfo(np.float64).eps * max(float(left.max(initial=0.0)), 0.0)
    rank = 0
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > least:
            break
        for x in (order, left):
            x[[k, p]] = x[[p, k]]
        factor[[k, p], :k] = factor[[p, k], :k]
        root = np.sqrt(left[k])
        factor[k, k] = root
        factor[k + 1:, k] = (a[order[k + 1:], order[k]] - factor[k + 1:, :k] @ factor[k, :k]) / root
        left[k + 1:] -= factor[k + 1:, k] ** 2
        rank = k + 1
    return factor[:, :rank], order


def _rounds(n: int):
    """Disjoint column pairs, so that n - 1 rounds (n even) meet all pairs once."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[:len(ring) // 2 - 1:-1], strict=True) if max(a, b) < n]
        yield np.array(pairs, np.int64).reshape(-1, 2).T
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor's columns, rotated pair by pair until all are orthogonal."""
    columns = np.ascontiguousarray(factor.T)    # one row per column
    n = len(columns)
    close = np.finfo(np.float64).eps * max(1.0, np.sqrt(factor.shape[0]))
    for _ in range(sweeps):
        worst = 0.0
        for p, q in _rounds(n) if n > 1 else ():
            x, y = columns[p], columns[q]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(xx * yy)
            turn = np.abs(xy) > close * size
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(xy[turn]) / size[turn]).max()))
            p, q, x, y, xx, yy, xy = p[turn], q[turn], x[turn], y[turn], xx[turn], yy[turn], xy[turn]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            columns[p], columns[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
        if worst == 0.0:
            break
    return columns.T


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (one per row), up to the rank."""
    factor, order = pivoted_cholesky(covariance)
    rotated = jacobi_columns(factor)
    values = (rotated * rotated).sum(axis=0)
    place = np.argsort(-values, kind="stable")
    vectors = np.zeros((len(place), len(covariance)))
    vectors[:, order] = (rotated / np.sqrt(values)).T[place]
    for v in vectors:
        if v[np.argmax(np.abs(v))] < 0:
            v *= -1
    return values[place], vectors


# ---- vectors

def whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a column of equally long ones, and their
    whole numbers, one row each."""
    if not len(column):
        return np.empty(0, np.int64), np.empty((0, 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    good = np.flatnonzero(np.isfinite(flat).all(axis=1))
    with np.errstate(over="ignore"):
        return good, np.clip(np.floor(SCALE * flat[good]), -TOP, TOP).astype(np.int64)


def pack_rows(x: np.ndarray) -> list[bytes]:
    """Each row as bytes of the narrowest type that holds it, which the first byte
    names: equal rows give equal bytes."""
    out: list[bytes] = [b""] * len(x)
    reach = np.maximum(x.max(axis=1), ~x.min(axis=1)) if x.size else np.zeros(len(x), np.int64)
    kind = np.searchsorted([1 << 15, 1 << 31], reach, side="right")
    for k, width in enumerate(("<i2", "<i4", "<i8")):
        at = np.flatnonzero(kind == k)
        rows = x[at].astype(width)
        for i, row in zip(at.tolist(), rows, strict=True):
            out[i] = bytes([k]) + row.tobytes()
    return out


def unpack_rows(packed) -> np.ndarray:
    """The rows that ``pack_rows`` packed."""
    rows = [np.frombuffer(p, ("<i2", "<i4", "<i8")[p[0]], offset=1) for p in packed]
    return np.array(rows, np.int64).reshape(len(rows), -1)


def _largest(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole number n * x - sums, divided once."""
    most = n * _largest(x) + max((abs(s) for s in sums), default=0)
    kind = np.int64 if most < 1 << 62 else object
    return ((n * x.astype(kind) - np.array(sums, kind)) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum of (n * x - sums)**2 over the dimensions of each row, exactly."""
    top, most = _largest(x), max((abs(s) for s in sums), default=0)
    d = max(1, x.shape[1])
    squares = (x * x).sum(axis=1) if d * top * top < 1 << 62 else (x.astype(object) ** 2).sum(axis=1)
    mixed = x @ np.array(sums, np.int64) if d * max(top, 1) * most < 1 << 62 else x.astype(object) @ np.array(sums, object)
    rest = sum(s * s for s in sums)
    return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, mixed, strict=True)]


# ---- jobs

def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vec of the rows with a vector of the commonest length."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    sizes = rows.where(finite).groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0].n if sizes else 0))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector of whole numbers once, packed."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack_rows(whole_numbers(batch.column("vec"))[1]), pa.binary())], ["x"])

    return rows.select("vec").mapInArrow(frugal(run), "x binary").distinct()


def _batches(batches, rows: int = 4_096):
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield unpack_rows(batch.column("x").slice(first, rows).to_pylist())


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their sum per dimension, exactly."""
    def run(batches):
        n, high, low = 0, 0, 0
        for x in _batches(batches):   # in halves, so that no batch overflows
            n += len(x)
            high = high + (x >> 32).sum(axis=0).astype(object)
            low = low + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            total = high * (1 << 32) + low
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
                 pa.array([n] * len(total), pa.int64())], ["dim", "total", "n"])

    sums = (fit.mapInArrow(run, "dim int, total decimal(38,0), n long").groupBy("dim")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("dim").collect())   # one row per dimension
    return (sums[0].n, [int(r.total) for r in sums]) if sums else (0, [])


_SCATTER = "dim int, salt int, line array<double>"


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The fit list's covariance, divisor n, centred before multiplying."""
    def run(batches):
        total = None
        for x in _batches(batches):
            y = centred(x, n, sums)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([salt] * len(total), pa.int32()),
                 pa.array(list(total), pa.list_(pa.float64()))], ["dim", "salt", "line"])

    def add(key, lines):
        own = lines.column("line").combine_chunks().flatten().to_numpy().reshape(lines.num_rows, -1).sum(axis=0)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "line": pa.array([own], pa.list_(pa.float64()))})

    partial = fit.mapInArrow(run, _SCATTER).groupBy("dim", "salt").applyInArrow(add, _SCATTER)
    lines = partial.groupBy("dim").applyInArrow(add, _SCATTER).orderBy("dim").collect()   # dimensions squared
    return np.array([r.line for r in lines], np.float64) / n


def whiten(embeddings: DataFrame, most: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal, exact; null from 39
    digits on), whitened, explained and identity_error for each usable row and
    each of the first ``most`` components."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = usable(embeddings)
    fit = cut(fit_list(rows))
    n, sums = exact_sums(fit)
    v = covariance(fit, n, sums) if n else np.zeros((0, 0))
    values, vectors = components(v)
    values, vectors = values[:most], vectors[:most]
    if not len(values):
        return spark.createDataFrame([], schema)
    explained = values / np.trace(v)
    shared = spark.sparkContext.broadcast((n, sums, vectors / np.sqrt(values)[:, None]))   # dimensions x components

    def fitted(batches):
        n, sums, basis = shared.value
        for x in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(centred(x, n, sums) @ basis.T), pa.list_(pa.float64()))], ["w"])

    # Spark's covariance merges centred sums
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    found = fit.mapInArrow(fitted, "w array<double>").agg(
        *(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))

    def run(batches):
        n, sums, basis = shared.value
        k = len(basis)
        for batch in batches:
            for first in range(0, batch.num_rows, 4_096):
                part = batch.slice(first, 4_096)
                good, x = whole_numbers(part.column("vec"))
                if not len(good):
                    continue
                exact = [Decimal(t) if t < 10 ** 38 else None for t in deviations(x, n, sums)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(good)).take(pa.array(np.repeat(np.arange(len(good)), k))),
                     pa.array(np.tile(np.arange(1, k + 1), len(good)), pa.int32()), pa.array(np.full(k * len(good), n), pa.int64()),
                     pa.array(exact, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(good)), k))),
                     pa.array((centred(x, n, sums) @ basis.T).ravel()), pa.array(np.tile(explained, len(good))),
                     pa.array(np.full(k * len(good), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(frugal(run), schema)
