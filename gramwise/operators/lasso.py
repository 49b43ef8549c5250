"""Lasso and its cross-validated path, from fold-wise cross-product matrices.

The objective is ``|y - Xw - b|^2 / (2n) + alpha |w|_1``.  Training on all folds but one needs only the sum of
the other folds' matrices, and the squared error on the fold left out is a quadratic form in that fold's
matrix, so the whole path is found without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwise.functions.columns import level
from gramwise.operators.gram import GramTable, Moments, Term
from gramwise.operators.ols import LinearModel
from gramwise.operators.prepare import complete_cases
from gramwise.operators.report import small_frame


def _coordinate_descent(q: np.ndarray, c: np.ndarray, alpha: float, w: np.ndarray, max_iter: int) -> np.ndarray:
    """Minimise ``w'Qw/2 - c'w + alpha |w|_1`` one coefficient at a time."""
    diagonal = np.diag(q)
    live = np.flatnonzero(diagonal > 0)
    w = np.where(diagonal > 0, w, 0.0)
    gradient = c - q @ w
    for _ in range(max_iter):
        largest = 0.0
        for j in live:
            z = gradient[j] + diagonal[j] * w[j]
            new = np.sign(z) * max(abs(z) - alpha, 0.0) / diagonal[j]
            step = new - w[j]
            if step:
                gradient -= q[:, j] * step
                w[j] = new
                largest = max(largest, abs(step) * diagonal[j])
        if largest <= 1e-12 * max(alpha, 1e-300):
            break
    return w


def _violation(q: np.ndarray, c: np.ndarray, alpha: float, w: np.ndarray) -> float:
    """How far ``w`` is from meeting the optimality conditions, relative to the penalty."""
    gradient = c - q @ w
    gap = np.where(w != 0, np.abs(gradient - alpha * np.sign(w)), np.maximum(np.abs(gradient) - alpha, 0.0))
    return float(gap.max(initial=0.0)) / max(alpha, 1e-300)


def lasso_path(q: np.ndarray, c: np.ndarray, alphas: Sequence[float], max_iter: int = 100_000) -> np.ndarray:
    """Solutions for descending penalties.

    Between two penalties at which a variable enters or leaves, the solution is linear in the penalty, so the
    path is followed from one such point to the next and read off at the wanted penalties.  Each solution is
    checked; where dependent variables make the walk inexact, coordinate descent finishes the work.
    """
    p = len(c)
    out = np.zeros((len(alphas), p))
    filled = 0
    position = float(np.max(np.abs(c), initial=0.0))
    while filled < len(alphas) and alphas[filled] >= position:
        filled += 1
    active: list[int] = []
    sign = np.zeros(p)
    usable = np.diag(q) > 0
    blocked: set[int] = set()
    first = int(np.argmax(np.abs(c))) if p else 0
    if position > 0:
        active, sign[first] = [first], np.sign(c[first])
    events = 0
    while filled < len(alphas) and active and events < 20 * (p + 1):
        events += 1
        a = np.array(active)
        both = np.linalg.solve(q[np.ix_(a, a)], np.column_stack([c[a], sign[a]]))
        u, v = both[:, 0], both[:, 1]
        below = position * (1.0 - 1e-12)
        base, slope = c - q[:, a] @ u, q[:, a] @ v
        rest = np.array([j for j in range(p) if usable[j] and j not in blocked and j not in active], dtype=int)
        nearest, entering, leaving = 0.0, None, None
        for side in (1.0, -1.0):
            with np.errstate(divide="ignore", invalid="ignore"):
                candidate = side * base[rest] / (1.0 - side * slope[rest])
            candidate = np.where((candidate > 0) & (candidate < below), candidate, 0.0)
            if len(rest) and candidate.max() > nearest:
                nearest, entering = float(candidate.max()), (int(rest[candidate.argmax()]), side)
        with np.errstate(divide="ignore", invalid="ignore"):
            candidate = np.where(v != 0, u / v, 0.0)
        candidate = np.where((candidate > 0) & (candidate < below), candidate, 0.0)
        if candidate.max() > nearest:
            nearest, leaving = float(candidate.max()), int(a[candidate.argmax()])
        while filled < len(alphas) and alphas[filled] >= nearest:
            out[filled, a] = u - alphas[filled] * v
            filled += 1
        position = nearest
        if leaving is not None:
            active.remove(leaving)
            sign[leaving] = 0.0
            blocked.clear()
        elif entering is not None:
            j, side = entering
            if q[j, j] - q[j, a] @ np.linalg.solve(q[np.ix_(a, a)], q[a, j]) > 1e-10 * q[j, j]:
                active.append(j)
                sign[j] = side
            else:
                blocked.add(j)
    for i, alpha in enumerate(alphas):
        if i >= filled or _violation(q, c, alpha, out[i]) > 1e-8:
            start = out[i] if i < filled else out[max(i - 1, 0)]
            out[i] = _coordinate_descent(q, c, alpha, start.copy(), max_iter)
            gap = _violation(q, c, alpha, out[i])
            if gap > 1e-6:
                raise ArithmeticError(f"no solution for penalty {alpha} within {max_iter} rounds: off by {gap:.1e} of it")
    return out


def _system(moments: Moments, label: str, terms: Sequence[Term], scale: np.ndarray):
    k = len(terms)
    mean, cross = moments.at([*terms, Term(label)])
    return cross[:k, :k] / np.outer(scale, scale) / moments.n, cross[:k, k] / scale / moments.n, mean


def lasso(
    moments: Moments,
    label: str,
    terms: Sequence[Term],
    alpha: float,
    scale: np.ndarray | None = None,
    max_iter: int = 100_000,
) -> LinearModel:
    """Lasso at one penalty.  With ``scale``, the penalty applies to coefficients of x / scale, and the model
    returned is in the units of x."""
    scale = np.ones(len(terms)) if scale is None else scale
    q, c, mean = _system(moments, label, terms, scale)
    w = lasso_path(q, c, [alpha], max_iter)[0] / scale
    return LinearModel(float(mean[-1] - w @ mean[:-1]), tuple(terms), w)


@dataclass(frozen=True)
class LassoCv:
    model: LinearModel
    alpha: float
    alphas: np.ndarray
    mse: np.ndarray  # alphas x folds
    scale: np.ndarray
    #: For each fold left out, and -1 for none, the intercepts and coefficients at all penalties, in the units of the rows.
    solutions: dict[int, tuple[np.ndarray, np.ndarray]] = field(repr=False, default_factory=dict)
    #: A point near the terms' means, about which the certificate sums.
    centre: np.ndarray | None = field(repr=False, default=None)

    def path(self, spark: SparkSession) -> DataFrame:
        rows = [(float(a), float(m)) for a, m in zip(self.alphas, self.mse.mean(axis=1), strict=True)]
        return small_frame(spark, "alpha double, mean_mse double", rows)

    def selected(self, spark: SparkSession) -> DataFrame:
        """Variables with a non-zero coefficient, largest magnitude first, per unit of the scaled variable."""
        rows = [
            (t.name, float(b * s))
            for t, b, s in zip(self.model.terms, self.model.coef, self.scale, strict=True)
            if b != 0
        ]
        rows.sort(key=lambda r: (-abs(r[1]), r[0]))
        return small_frame(spark, "variable string, coefficient double", rows)

    def certificate(self, df: DataFrame, label: str, part: str) -> DataFrame:
        """``fold, alpha, n, objective, gap``: whether the solutions are optimal, judged by the rows and not by the matrices.

        One pass sums, for every fold left out and every penalty, the products of each term with the residuals of that
        solution.  At an optimum they are the penalty, with the coefficient's sign, for terms in the model, no more than it
        for the others, and nothing for the intercept; ``gap`` is the largest departure as a share of the penalty.  A task sends one
        row per fold and penalty.
        """
        terms = self.model.terms
        numeric = list(dict.fromkeys(t.column for t in terms if t.value is None))
        categorical = list(dict.fromkeys(t.column for t in terms if t.value is not None))
        folds = sorted(self.solutions)
        rows = df.select(
            F.col(part).cast("int").alias("__part"), F.col(label).cast("double").alias("__y"),
            *[F.col(c).cast("double").alias(c) for c in numeric], *[level(F.col(c)).alias(c) for c in categorical],
        )
        rows = complete_cases(rows, ["__y", *numeric])
        centre = np.zeros(len(terms)) if self.centre is None else self.centre
        # The intercept comes last, that of terms about their centre.
        coef = np.stack([np.column_stack([b, a + b @ centre]) for a, b in (self.solutions[f] for f in folds)])
        scale, sides = np.append(self.scale, 1.0), [(t.column, t.value) for t in terms]
        count, size = coef.shape[1:]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slopes = np.zeros((len(folds), count, size))
            squares, sizes = np.zeros((len(folds), count)), np.zeros(len(folds), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = {c: batch.column(c) for c in (*numeric, *categorical)}
                x = np.column_stack(
                    [columns[c].to_numpy() if v is None else pc.equal(columns[c], v).to_numpy(zero_copy_only=False) for c, v in sides]
                ).astype(float)
                x = np.column_stack([x - centre, np.ones(len(x))])
                y, parts = batch.column("__y").to_numpy(), batch.column("__part").to_numpy()
                for i, fold in enumerate(folds):
                    rest = parts != fold
                    residual = y[rest, None] - x[rest] @ coef[i].T
                    slopes[i] += residual.T @ (x[rest] / scale)
                    squares[i] += (residual * residual).sum(0)
                    sizes[i] += int(rest.sum())
            if sizes.any():
                at = np.arange(len(folds)).repeat(count)
                yield pa.RecordBatch.from_pydict(
                    {
                        "fold": pa.array(np.array(folds)[at], pa.int32()),
                        "step": pa.array(np.tile(np.arange(count), len(folds)), pa.int32()),
                        "n": pa.array(sizes[at]),
                        "squares": pa.array(squares.ravel()),
                        "slopes": pa.array(list(slopes.reshape(-1, size)), pa.list_(pa.float64())),
                    }
                )

        schema = "fold int, step int, n bigint, squares double, slopes array<double>"
        sums = rows.mapInArrow(add, schema).select("fold", "step", "n", "squares", F.posexplode("slopes").alias("term", "slope"))
        sums = sums.groupBy("fold", "step", "term").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.sum("slope").alias("slope"))
        known = small_frame(
            df.sparkSession, "fold int, step int, term int, alpha double, w double",
            [
                (f, s, t, float(self.alphas[s]), float(coef[i, s, t] * scale[t]) if t < len(sides) else None)
                for i, f in enumerate(folds) for s in range(count) for t in range(size)
            ],
        )
        slope, alpha, w = F.col("slope") / F.col("n"), F.col("alpha"), F.col("w")
        gap = F.when(w.isNull(), F.abs(slope)).when(w != 0, F.abs(slope - alpha * F.signum(w))).otherwise(F.greatest(F.abs(slope) - alpha, F.lit(0.0))) / alpha
        return sums.join(known, ["fold", "step", "term"]).groupBy("fold", "alpha").agg(
            F.first("n").alias("n"),
            (F.first("squares") / F.first("n") / 2 + F.first("alpha") * F.sum(F.abs("w"))).alias("objective"),
            F.max(gap).alias("gap"),
        )


def lasso_cv(
    grams: GramTable,
    label: str,
    terms: Sequence[Term],
    folds: Sequence[int],
    n_alphas: int = 100,
    eps: float = 1e-3,
    standardize: bool = False,
    max_iter: int = 100_000,
) -> LassoCv:
    """Choose the penalty by k-fold cross-validation and refit on all folds.

    The grid runs in equal log steps from the smallest penalty that removes every variable down to ``eps``
    times that; the least mean squared error over the folds wins, the larger penalty on a tie.
    ``standardize`` divides by the population standard deviation of the training rows.
    """
    folds = [f for f in folds if f in grams.groups]
    if len(folds) < 2:
        raise ValueError("cross-validation needs at least two folds with rows")
    y, k = Term(label), len(terms)
    train = grams.moments(folds)
    scale = np.ones(k)
    if standardize:
        variance = np.diag(train.at(terms)[1]) / train.n
        scale = np.where(variance > 0, np.sqrt(variance), 1.0)
    _, c, _ = _system(train, label, terms, scale)
    top = float(np.max(np.abs(c)))
    if top <= 0:
        raise ValueError("no variable is related to the label")
    alphas = top * np.logspace(0.0, np.log10(eps), n_alphas)

    mse = np.empty((n_alphas, len(folds)))
    solutions = {}
    for f, held in enumerate(folds):
        fit, test = grams.moments([g for g in folds if g != held]), grams.moments([held])
        q, c, fit_mean = _system(fit, label, terms, scale)
        b = lasso_path(q, c, alphas, max_iter) / scale
        solutions[held] = fit_mean[k] - b @ fit_mean[:k], b
        mean, cross = test.at([*terms, y])
        bias = (mean[k] - fit_mean[k]) - b @ (mean[:k] - fit_mean[:k])
        spread = cross[k, k] - 2.0 * b @ cross[:k, k] + np.einsum("ai,ij,aj->a", b, cross[:k, :k], b)
        mse[:, f] = spread / test.n + bias * bias
    best = int(np.argmin(mse.mean(axis=1)))
    q, c, mean = _system(train, label, terms, scale)
    b = lasso_path(q, c, alphas, max_iter) / scale
    solutions[-1] = mean[k] - b @ mean[:k], b
    model = LinearModel(float(solutions[-1][0][best]), tuple(terms), b[best])
    return LassoCv(model, float(alphas[best]), alphas, mse, scale, solutions, mean[:k])
