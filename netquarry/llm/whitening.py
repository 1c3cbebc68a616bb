"""Embedding whitening by cyclic Jacobi.

Vectors become integers, whose sums are exact. The scatter matrix is gathered from centred vectors, one partial matrix a
task, and its d x d cells are summed by a shuffle. The driver holds that one matrix and applies symmetric rotations, sweep
by sweep over all pairs, until every off-diagonal entry vanishes against its own two diagonal entries; that relative test
is what makes small eigenvalues accurate. The sorted components, divided by the roots of their eigenvalues, go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: A vector's entry c becomes floor(SCALE c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond it have no exact integer; a vector that holds one is left out.
LARGEST = float(1 << 52)
#: Sweeps at most; convergence is quadratic, so that some ten do at any size.
SWEEPS = 60
#: Digits that a decimal can hold.
DIGITS = 38


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its entries are finite and small enough for an exact integer."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < LARGEST)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def integers(vector: Column) -> Column:
    """A usable vector as integers, array<bigint>."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT)


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix of no negative eigenvalue.

    A sweep takes each pair of rows once, in rounds of disjoint pairs, whose rotations are applied together.
    """
    d = len(matrix)
    size = d + d % 2
    a, v = np.zeros((size, size)), np.eye(size)
    a[:d, :d] = (matrix + matrix.T) / 2
    order = np.arange(size)
    floor = np.finfo(float).tiny
    for _ in range(SWEEPS):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        if np.all(off <= np.finfo(float).eps * np.sqrt(np.outer(diagonal, diagonal)) + floor):
            break
        for _ in range(size - 1):
            p, q = order[: size // 2], order[: size // 2 - 1 : -1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            both, app, aqq = a[p, q], a[p, p], a[q, q]
            live = np.abs(both) > floor
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * np.where(live, both, 1.0))
                t = np.where(live, np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0)), 0.0)
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            rows_p, rows_q = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = app - t * both, aqq + t * both
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
    # A row that made the size even meets only zeros, so it is never turned.
    values, vectors = np.diag(a)[:d].copy(), v[:d, :d]
    by = np.argsort(-values, kind="stable")
    return values[by], vectors[:, by]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A list column of equal lengths as rows."""
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.values
    return np.asarray(flat).astype(kind).reshape(len(column), -1)


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """n x - S of integer rows, exact: 64-bit integers where they do, Python's beyond."""
    mean = np.array([s // n for s in sums], np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, mean, strict=True)]
    y = x - mean
    if len(y) and int(np.abs(y).max()) >= (1 << 62) // n:
        y = y.astype(object)
    return y * n - np.array(rest, y.dtype)


def scatter(rows: DataFrame, column: str, centre) -> dict[tuple[int, int], float]:
    """Upper half of the sum of outer products of centre(rows of column): a partial matrix a task, summed cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = centre(batch.column(column))
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "x"])

    cells = rows.select(column).mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    return {(r["i"], r["j"]): r["x"] for r in cells.collect()}


def _square(cells: dict[tuple[int, int], float], d: int, n: int) -> np.ndarray:
    out = np.zeros((d, d))
    for (i, j), x in cells.items():
        out[i, j] = out[j, i] = x / n
    return out


def whiten(rows: DataFrame, key: str, vector: str, most: int = 32) -> DataFrame:
    """key, component, n, deviation (decimal), whitened, explained and identity_error of each usable row and component.

    Rows whose vector is null, empty, or holds a null, a value that isn't finite or one beyond LARGEST / SCALE are left
    out, and so are those of another dimension than most rows have (of equal numbers the largest). Repeated rows and keys
    are rows of their own, a null key stays. Components are unit eigenvectors of the covariance of the integer vectors
    (divisor n), numbered from 1 by falling eigenvalue, at most `most`; those whose eigenvalue is lost in rounding can't
    be divided by and are left out, so vectors that are all equal give no row, and neither does an empty table.
    """
    spark = rows.sparkSession
    shape = f"component int, n long, deviation decimal({DIGITS},0), whitened double, explained double, identity_error double"
    held = rows.filter(usable(F.col(vector))).select(F.col(key).alias("_key"), integers(F.col(vector)).alias("x"))
    sizes = held.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = spark.createDataFrame([], rows.select(key).schema).selectExpr("*", *(f"CAST(NULL AS {k.split()[1]}) AS {k.split()[0]}" for k in shape.split(", ")))
    if sizes is None:
        return empty
    d, n = sizes["d"], sizes["n"]
    held = scratch.save(held.filter(F.size("x") == d), "integers")
    sums = {r["i"]: int(r["s"]) for r in held.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()}
    sums = [sums[i] for i in range(d)]
    cells = scatter(held, "x", lambda c: centred(_matrix(c, "i8"), sums, n).astype(float) / n)
    values, vectors = jacobi(_square(cells, d, n))
    trace = float(values.sum())
    k = int((values > d * np.finfo(float).eps * max(values[0], 0.0)).sum()) if trace > 0 else 0
    k = min(k, most)
    if not k:
        return empty
    matrix = vectors[:, :k] / np.sqrt(values[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = centred(_matrix(batch.column("x"), "i8"), sums, n)
            if y.dtype == object or float((y.astype(float) ** 2).sum(1).max()) > 2.0**62:
                exact = [sum(int(v) ** 2 for v in row) for row in y]
                deviation = pa.array([Decimal(v) if v < 10**DIGITS else None for v in exact], pa.decimal128(DIGITS, 0))
            else:
                deviation = pa.array((y * y).sum(1)).cast(pa.decimal128(DIGITS, 0))
            white = (y.astype(float) / n) @ matrix
            offsets = pa.array(np.arange(len(white) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), deviation, pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names=["_key", "deviation", "w"])

    kind = held.select("_key").schema["_key"].dataType.simpleString()
    white = scratch.save(held.mapInArrow(run, f"_key {kind}, deviation decimal({DIGITS},0), w array<double>"), "whitened")
    means = {r["i"]: r["m"] for r in white.select(F.posexplode("w").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()}
    mean = np.array([means[i] for i in range(k)])
    error = float(np.abs(_square(scatter(white, "w", lambda c: _matrix(c, "f8") - mean), k, n) - np.eye(k)).max())
    explained = F.array(*(F.lit(float(v) / trace) for v in values[:k]))
    out = white.select("_key", "deviation", F.posexplode("w").alias("pos", "whitened"))
    return out.select(
        F.col("_key").alias(key),
        (F.col("pos") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("pos")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
