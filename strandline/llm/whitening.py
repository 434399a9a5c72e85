"""Whitening of embeddings by the leading eigenvectors of their covariance.

Counts, sums and centred products are added up by tasks; the driver sees one row a dimension. There the
covariance is brought to tridiagonal form by Householder reflections, its leading eigenvalues are found by
bisection on Sturm counts, and their vectors by inverse iteration, orthogonalised within clusters. The
components go to the tasks that project the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.components import cut_lineage

#: A component is entered as the whole number below SCALE times it.
SCALE = 256
#: Eigenvalues nearer than this share of the matrix's norm form a cluster; rounds of inverse iteration.
CLUSTER, ROUNDS = 1e-3, 6
#: Rows that are centred and multiplied together.
ROWS = 8192


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix; reflection k is a unit vector on the coordinates from k + 1 on, or empty."""
    a, n = a.copy(), len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if not length or not np.any(x[1:]):
            reflections.append(np.empty(0))
            continue
        x[0] += np.copysign(length, x[0])
        v = x / np.linalg.norm(x)
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = 2 * (p - (v @ p) * v)
        part -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def back(vectors: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """Columns in the tridiagonal matrix's coordinates, in the first matrix's."""
    out = vectors.copy()
    for k in range(len(reflections) - 1, -1, -1):
        if len(v := reflections[k]):
            out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of the values."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares, count = np.concatenate([[0.0], off * off]), np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for d, s in zip(diagonal, squares, strict=True):
        q = d - at - s / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The count largest eigenvalues, falling, each by bisection until its interval has no double inside."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = np.full(count, (diagonal - reach).min()), np.full(count, (diagonal + reach).max())
    below = n - 1 - np.arange(count)  # eigenvalues under the k-th largest
    low, high = low - np.abs(low) * 1e-15, high + np.abs(high) * 1e-15
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        under = sturm_counts(diagonal, off, middle) <= below
        low, high = np.where(under, middle, low), np.where(under, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - value) x = b by elimination with row exchanges; vanishing pivots are made tiny."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    tiny = norm * np.finfo(float).eps
    u, u1, u2, factor, swap = (np.zeros(n) for _ in range(5))
    a, b = diagonal[0] - value, off[0] if n > 1 else 0.0
    for i in range(n - 1):
        c, d, e = off[i], diagonal[i + 1] - value, off[i + 1] if i + 2 < n else 0.0
        if abs(c) > abs(a):
            swap[i], factor[i] = 1, a / c
            u[i], u1[i], u2[i] = c, d, e
            a, b = b - factor[i] * d, -factor[i] * e
        else:
            a = a if abs(a) > tiny else tiny
            factor[i] = c / a
            u[i], u1[i] = a, b
            a, b = d - factor[i] * b, e
    u[n - 1] = a if abs(a) > tiny else tiny

    def solve(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for i in range(n - 1):
            if swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            x[i] = (x[i] - (u1[i] * x[i + 1] if i + 1 < n else 0) - (u2[i] * x[i + 2] if i + 2 < n else 0)) / u[i]
        return x

    return solve


def leading_components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the count largest eigenvalues above rounding, falling."""
    n = len(covariance)
    scale = np.abs(covariance).max(initial=0)
    if not scale:
        return np.empty(0), np.empty((n, 0))
    diagonal, off, reflections = tridiagonal(covariance / scale)
    values = leading_values(diagonal, off, min(count, n))
    values = values[values > n * np.finfo(float).eps * np.abs(values).max()]
    norm, random = np.abs(values).max(), np.random.Generator(np.random.PCG64(7))
    vectors = np.empty((n, len(values)))
    for k, value in enumerate(values):
        # equal values are told apart, so that their iterations do not divide by the same pivots
        near = [j for j in range(k) if values[j] - value < CLUSTER * norm]
        solve = _solver(diagonal, off, value - len([j for j in near if values[j] - value < 1e-13 * norm]) * 1e-14 * norm)
        x = random.standard_normal(n)
        for _ in range(ROUNDS):
            x = solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for j in near * 2:
                x -= (vectors[:, j] @ x) * vectors[:, j]
            if np.linalg.norm(x) < 1e-8:  # all of it was in the cluster's other vectors
                x = random.standard_normal(n)
                for j in near * 2:
                    x -= (vectors[:, j] @ x) * vectors[:, j]
        vectors[:, k] = x / np.linalg.norm(x)
    return values * scale, back(vectors, reflections)


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def _whole(vectors: pa.Array, dim: int) -> np.ndarray:
    x = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(x).max(initial=0) >= 1 << 62:
        raise OverflowError("a component beyond 2**54")
    return x.astype(np.int64).reshape(-1, dim)


def _encode(dim: int):
    """A vector of whole numbers as bytes, each number in the fewest of 2, 4 or 8 that hold all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(0), dim)
            most = np.abs(x + (x < 0)).max(axis=1, initial=0)  # -2**15 fits, 2**15 does not
            codes = [v.astype("<i2" if m < 1 << 15 else "<i4" if m < 1 << 31 else "<i8").tobytes() for v, m in zip(x, most.tolist(), strict=True)]
            yield pa.record_batch([pa.array(codes, pa.binary())], names=["code"])

    return run


def _decode(codes: pa.Array, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(c, f"<i{len(c) // dim}") for c in codes.to_pylist()], np.int64).reshape(-1, dim)


def _add_up(dim: int):
    """Rows and sums of each task, one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, large = 0, np.zeros(dim, np.int64), 0
        for batch in batches:
            x = _decode(batch.column(0), dim)
            n, total, large = n + len(x), total + x.sum(axis=0), max(large, int(np.abs(x).max(initial=0)))
            if large * n >= 1 << 63:
                raise OverflowError("sums beyond 63 bits")
        yield pa.record_batch([np.arange(dim, dtype=np.int32), np.full(dim, n), total, np.full(dim, large)], names=["i", "n", "s", "large"])

    return run


def _multiply(dim: int, centre: np.ndarray, project: np.ndarray):
    """Centred products of each task: one row (i, products of i with all) a projected dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((project.shape[1],) * 2)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                y = (_decode(batch.column(0).slice(at, ROWS), dim) - centre) @ project
                total += y.T @ y
        yield _rows(dict(enumerate(total)))

    return run


def _rows(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(totals), pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["i", "v"])


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            totals[i] = totals[i] + v if i in totals else np.array(v)
    yield _rows(totals)


def _products(fit: DataFrame, dim: int, centre: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the centred, projected rows of fit; a task adds up the tasks' rows of a few dimensions as they come."""
    width = project.shape[1]
    parts = min(width, int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = fit.mapInArrow(_multiply(dim, centre, project), "i int, v array<double>").repartitionById(parts, F.col("i")).mapInArrow(_sum_rows, "i int, v array<double>").collect()
    out = np.zeros((width, width))
    for r in rows:
        out[r.i] = r.v
    return (out + out.T) / 2


def _project(dim: int, n: int, sums: list[int], large: int, vectors: np.ndarray, values: np.ndarray, explained: np.ndarray, error: float):
    kinds = (pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = vectors / np.sqrt(values), len(values)
        mean = np.array([s / n for s in sums])
        for batch in batches:
            x = _whole(batch.column(1), dim)
            most = max(large, int(np.abs(x).max(initial=0)))
            if dim * (2 * n * most) ** 2 < 1 << 63:
                deviation = pa.array(((n * x - np.array(sums)) ** 2).sum(axis=1)).cast(pa.decimal128(19, 0)).cast(pa.decimal128(38, 0))
            else:
                from decimal import Decimal

                wide = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
                deviation = pa.array([Decimal(int(d)) for d in wide], pa.decimal128(38, 0))
            white = (x - mean) @ parts
            each = np.repeat(np.arange(len(batch)), count)
            columns = (np.tile(np.arange(1, count + 1), len(batch)), np.full(len(each), n), deviation.take(pa.array(each)), white.ravel(), np.tile(explained, len(batch)), np.full(len(each), error))
            yield pa.record_batch([batch.column(0).take(pa.array(each)), *(c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row on the leading components, whitened.

    A component c of a vector becomes x = floor(256 * c). The mean and covariance (divisor n) are of the n
    distinct x-vectors, so that repeated vectors count once; each row, also a repeated one, is returned
    for each component, numbered from 1 by falling eigenvalue. deviation: the exact sum of (n * x - S)^2,
    as decimal(38,0), S being the sums; whitened: x - S / n on the unit eigenvector over the root of its
    eigenvalue; explained: the eigenvalue's share of the trace; identity_error: the largest absolute
    difference of the whitened vectors' covariance from the identity.

    Rows whose vector is null, empty, of another than the commonest length (ties: the shorter), or with
    null or non-finite components take no part; null ids stay. Components without variance (eigenvalue
    not above rounding) are left out: equal vectors and a single one give no rows, as does an empty table.
    Other columns are ignored. Components from 2**54, or 2**55 / rows, on raise. The driver holds the sums and a
    covariance of dimensions squared, whatever the rows. A task's products are dimensions squared, so
    partitions should hold more rows than the vectors have components.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), vector.alias("v")).where(finite(F.col("v")))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim)
    # equal vectors meet before the shuffle, too
    fit = cut_lineage(rows.select("v").mapInArrow(_encode(dim), "code binary").distinct())
    sums = fit.mapInArrow(_add_up(dim), "i int, n long, s long, large long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("large").alias("large")).orderBy("i").collect()
    n, large, s = sums[0].n, max(r.large for r in sums), [r.s for r in sums]
    mean = np.array([v / n for v in s])
    covariance = _products(fit, dim, mean, np.eye(dim)) / n
    values, parts = leading_components(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    white = _products(fit, dim, mean, parts / np.sqrt(values)) / n
    error = float(np.abs(white - np.eye(len(values))).max())
    return rows.mapInArrow(_project(dim, n, s, large, parts, values, values / np.trace(covariance), error), schema).withColumnRenamed("vec_id", id_col)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
