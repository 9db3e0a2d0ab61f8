"""Whitening of embeddings: leading principal components of the covariance, scaled to unit variance.

Sums, covariance and projection are computed where the rows are; only sums of one
entry for each dimension, or each pair of dimensions, meet on the driver. There the
covariance is brought to tridiagonal form by reflections, its leading eigenvalues
are bisected by Sturm counts, and inverse iteration gives the components, which go
back to the tasks as one small matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.operators.durable import settle

#: Entries become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: A larger entry has no exact whole number in a double; its row is left out.
LARGEST = 2.0**42
#: Eigenvalues closer than this part of the largest one are one cluster.
CLUSTER = 1e-3
#: A component with less than this part of the largest variance is rounding, not variance.
RANK = 1e-12
_EPS = float(np.finfo(float).eps)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections, and their vectors."""
    a = np.array(matrix, float)
    n = len(a)
    vectors: list[np.ndarray | None] = []
    for k in range(n - 2):
        column = a[k + 1:, k].copy()
        length = np.sqrt(column @ column)
        if not np.any(column[1:]) or length == 0:
            vectors.append(None)
            continue
        alpha = -np.copysign(length, column[0])
        column[0] -= alpha
        v = column / np.sqrt(column @ column)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0.0
        a[k + 1, k] = a[k, k + 1] = alpha
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), vectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number."""
    tiny = np.finfo(float).tiny / _EPS
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d - at - e * e / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection to the last bits."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    bound = max(np.max(np.abs(diagonal) + reach), np.finfo(float).tiny)
    rank = n - 1 - np.arange(min(most, n))
    low, high = np.full(len(rank), -bound * 1.01), np.full(len(rank), bound * 1.01)
    for _ in range(200):
        middle = (low + high) / 2
        above = sturm_counts(diagonal, off, middle) > rank
        high, low = np.where(above, middle, high), np.where(above, low, middle)
        if np.all(high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)) + _EPS * _EPS * bound):
            break
    return (low + high) / 2


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; pivots are at least ``least``."""
    n = len(diagonal)
    d, u, b = diagonal - shift, np.append(off, 0.0), right.copy()
    uu = np.zeros(n)
    for i in range(n - 1):
        below, next_d, next_u = off[i], d[i + 1], u[i + 1]
        if abs(d[i]) >= abs(below):
            if d[i] == 0.0:
                d[i] = least
            f = below / d[i]
            d[i + 1] = next_d - f * u[i]
            b[i + 1] -= f * b[i]
        else:
            f = d[i] / below
            d[i + 1] = u[i] - f * next_d
            d[i], u[i], uu[i] = below, next_d, next_u
            u[i + 1] = -f * next_u
            b[i], b[i + 1] = b[i + 1], b[i] - f * b[i + 1]
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        pivot = d[i] if abs(d[i]) > least else np.copysign(least, d[i] or 1.0)
        rest = b[i] - (u[i] * x[i + 1] if i + 1 < n else 0.0) - (uu[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / pivot
        if abs(x[i]) > 1e150:  # only the direction matters
            x /= 1e150
            b /= 1e150
    return x


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as rows, by inverse iteration; those of a cluster are kept at right angles."""
    n = len(diagonal)
    size = max(np.max(np.abs(diagonal), initial=0.0), np.max(np.abs(off), initial=0.0), np.finfo(float).tiny)
    out = np.zeros((len(values), n))
    for k, value in enumerate(values):
        near = [j for j in range(k) if abs(values[j] - value) <= CLUSTER * size]
        x = np.random.default_rng(k).uniform(-1.0, 1.0, n)
        before = None
        for _ in range(12):
            x = _solve_shifted(diagonal, off, float(value), x, _EPS * size)
            x /= np.max(np.abs(x))
            for _ in range(2):
                for j in near:
                    x -= (out[j] @ x) * out[j]
            x /= np.sqrt(x @ x)
            if before is not None and 1.0 - abs(before @ x) <= 4 * _EPS:
                break
            before = x.copy()
        out[k] = x
    return out


def leading_components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as rows; the largest entry of each is positive."""
    scale = float(np.max(np.abs(covariance), initial=0.0))
    if scale == 0.0:
        return np.zeros(0), np.zeros((0, len(covariance)))
    diagonal, off, reflections = tridiagonal(covariance / scale)
    values = leading_eigenvalues(diagonal, off, most)
    values = values[values > RANK * values[0]]
    vectors = eigenvectors(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        if v is not None:
            tail = vectors[:, k + 1:]
            tail -= 2.0 * np.outer(tail @ v, v)
    vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    top = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return values * scale, vectors * np.sign(top)[:, None]


@dataclass(frozen=True)
class Whitened:
    """``frame`` has the rows with ``deviation`` and ``whitened`` (one number for each component)."""

    frame: DataFrame
    n: int
    sums: list[int]
    explained: list[float]
    components: list[list[float]]
    identity_error: float | None


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _whole(entries: np.ndarray) -> np.ndarray:
    return np.floor(entries * SCALE).astype(np.int64) + SHIFT


def _sums(valid: DataFrame, width: int) -> list[int]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += _whole(_matrix(batch.column(0), width)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "s"])

    rows = valid.select("vector").mapInArrow(partial, "i int, s bigint").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [s for _, s in sorted(map(tuple, rows))]


def _covariance(valid: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Products of centred entries, added up in each partition first; one row of the matrix is one message."""
    width = len(mean)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            centred = _whole(_matrix(batch.column(0), width)) - mean
            total += centred.T @ centred
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    products = valid.select("vector").mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width))
    # One number for each pair of dimensions, however many rows there are.
    for i, j, s in products.collect():
        out[i, j] = out[j, i] = s / n
    return out


def _identity_error(frame: DataFrame, most: int) -> float | None:
    """Largest absolute entry of the covariance of what was whitened, less the identity."""
    at = [F.col("whitened")[k] for k in range(most)]
    means = frame.agg(*[F.avg(x) for x in at]).first()
    centred = [x - F.lit(m) for x, m in zip(at, means)]
    products = [F.avg(centred[i] * centred[j]) - F.lit(float(i == j)) for i in range(most) for j in range(i, most)]
    return max(abs(x) for x in frame.agg(*products).first())


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitened:
    """Whiten the vectors of a table: their leading components, each with unit variance.

    Rows are left out whose vector is null or empty, holds a null or a number that
    is not finite or beyond 2^42, or has another length than most (of lengths
    equally frequent, the longest). All others are fitted and projected.
    ``frame`` has the other columns, ``deviation`` (the exact squared distance from
    the sums, null where no long can hold it) and ``whitened``; columns of these
    two names are replaced. There are fewer components than asked if the
    vectors are shorter or span less, none for equal vectors; an empty table stays
    empty. Repeated rows count as often as they occur.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c not in (vector, "deviation", "whitened")]
    entries = F.col(f"`{vector}`").cast("array<double>")
    sound: Column = F.coalesce(F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)), F.lit(False))
    finite = rows.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), entries.alias("vector")).filter(sound)
    usual = finite.groupBy(F.size("vector").alias("width")).count().filter("width > 0").orderBy(F.desc("count"), F.desc("width")).first()
    schema = finite.select("row", F.lit(None).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("whitened")).schema
    plain = [F.col(f"row.`{c}`").alias(c) for c in others]
    if usual is None:
        return Whitened(spark.createDataFrame([], schema).select(*plain, "deviation", "whitened"), 0, [], [], [], None)
    width, n = usual["width"], usual["count"]
    valid = finite.filter(F.size("vector") == width)
    sums = _sums(valid, width)
    exact, mean = np.array(sums, np.int64), np.array([s / n for s in sums])
    covariance = _covariance(valid, mean, n)
    values, axes = leading_components(covariance, components)
    scaled = (axes / np.sqrt(values)[:, None]).T if len(values) else np.zeros((width, 0))
    held = spark.sparkContext.broadcast((exact, mean, scaled))  # width x components numbers

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, centre, axis = held.value
        for batch in batches:
            x = _whole(_matrix(batch.column(1), width))
            # Whole numbers wrap around, so a sum that fits is right whatever came before.
            away = n * x - total
            deviation = (away * away).sum(axis=1)
            size = (away.astype(float) ** 2).sum(axis=1)
            out = (x - centre) @ axis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * axis.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, mask=size > 9.2e18), lists], ["row", "deviation", "whitened"])

    frame = settle(valid.mapInArrow(projected, schema), "whitened")
    error = _identity_error(frame, len(values)) if len(values) else None
    trace = float(np.trace(covariance))
    return Whitened(frame.select(*plain, "deviation", "whitened"), n, sums, [float(v) / trace for v in values], axes.tolist(), error)
