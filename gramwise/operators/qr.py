"""Least squares, rank and condition number from a tall-skinny QR decomposition.

Eigenvalues of a cross-product matrix lose half of the digits.  Here each task reduces its rows to the triangular factor of their
own decomposition, and factors are merged in the same way, a few dozen at a time, by a tree of tasks.  One row of p(p + 1)/2
useful numbers leaves each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.operators.prepare import complete_cases

#: Factors that one task merges.
MERGED_AT_ONCE = 32
_SCHEMA = "n bigint, factor array<double>"


def _triangle(stack: list[np.ndarray], width: int) -> np.ndarray:
    r = np.linalg.qr(np.vstack(stack), mode="r")
    return np.vstack([r, np.zeros((max(width - len(r), 0), width))])


def r_factor(df: DataFrame, columns: Sequence[str], intercept: bool = False) -> tuple[int, np.ndarray]:
    """Complete rows of the columns, and the triangular factor of their matrix, a leading column of ones included if asked for."""
    rows = complete_cases(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    width = len(columns) + int(intercept)

    def packed(n: int, factor: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "factor": pa.array([factor.ravel()], pa.list_(pa.float64()))})

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, n = np.zeros((0, width)), 0
        for batch in batches:
            if batch.num_rows:
                x = [np.ones(batch.num_rows)] * int(intercept) + [c.to_numpy() for c in batch.columns]
                factor, n = _triangle([factor, np.column_stack(x)], width), n + batch.num_rows
        if n:
            yield packed(n, factor)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, n = np.zeros((0, width)), 0
        for batch in batches:
            for count, values in zip(batch.column("n").to_pylist(), batch.column("factor").to_pylist(), strict=True):
                factor, n = _triangle([factor, np.array(values).reshape(width, width)], width), n + count
        if n:
            yield packed(n, factor)

    factors = rows.mapInArrow(reduce, _SCHEMA)
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while parts > MERGED_AT_ONCE:
        parts = math.ceil(parts / MERGED_AT_ONCE)
        factors = factors.repartition(parts).mapInArrow(merge, _SCHEMA)
    factors = factors.coalesce(MERGED_AT_ONCE).mapInArrow(merge, _SCHEMA)
    found = factors.collect()
    if not found:
        raise ValueError("no complete rows")
    return sum(r["n"] for r in found), _triangle([np.array(r["factor"]).reshape(width, width) for r in found], width)


@dataclass(frozen=True)
class LeastSquares:
    names: tuple[str, ...]
    coef: np.ndarray
    n: int
    rank: int
    rss: float
    condition: float


def least_squares(df: DataFrame, label: str, columns: Sequence[str], intercept: bool = True, scaled: bool = False) -> LeastSquares:
    """Coefficients, rank, residual sum of squares and condition number.

    A deficient system gets the solution of smallest norm.  With ``scaled``, rank and condition are those of columns of length one.
    """
    n, r = r_factor(df, [*columns, label], intercept)
    names = (("_cons",) if intercept else ()) + tuple(columns)
    k = len(names)
    x, y = r[:, :k], r[:, k]
    length = np.linalg.norm(x, axis=0)
    length = np.where(length > 0, length, 1.0)
    # Columns of like length, so that the rank does not depend on their units.
    _, values, _ = np.linalg.svd(x / length)
    rank = int((values > max(n, k) * np.finfo(float).eps * values[0]).sum())
    if not scaled:
        values = np.linalg.svd(x, compute_uv=False)
    if rank == k:
        coef = np.linalg.solve(x[:k], y[:k])
    else:
        coef = np.linalg.lstsq(x, y, rcond=max(n, k) * np.finfo(float).eps)[0]
    rest = y - x @ coef
    return LeastSquares(names, coef, n, rank, float(rest @ rest), float(values[0] / values[-1]) if values[-1] > 0 else math.inf)
