"""Ordinary least squares with inference, from a cross-product matrix."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwise.functions import distributions as dist
from gramwise.functions.columns import level
from gramwise.operators.gram import GramTable, Moments, Term, gram_table
from gramwise.operators.prepare import complete_cases
from gramwise.operators.report import small_frame

RANK_TOLERANCE = 1e-10


@dataclass(frozen=True)
class LinearModel:
    """Intercept and coefficients; predicts as a column expression."""

    intercept: float
    terms: tuple[Term, ...]
    coef: np.ndarray

    def coefficient(self, name: str) -> float:
        return float(self.coef[[t.name for t in self.terms].index(name)])

    def predict(self, replace: Mapping[str, Column] | None = None) -> Column:
        """Predicted value.  ``replace`` substitutes expressions for numeric columns.

        A category unknown to the model adds nothing (the base level); a missing number gives null.
        """
        replace = replace or {}
        value = F.lit(self.intercept)
        by_column: dict[str, dict[str, float]] = {}
        for term, b in zip(self.terms, self.coef, strict=True):
            if term.value is None:
                value = value + F.lit(float(b)) * replace.get(term.column, F.col(term.column)).cast("double")
            else:
                by_column.setdefault(term.column, {})[term.value] = float(b)
        for column, weights in by_column.items():
            lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(weights.items())])
            value = value + F.coalesce(lookup[level(F.col(column))], F.lit(0.0))
        return value

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("_cons", self.intercept)] + [(t.name, float(b)) for t, b in zip(self.terms, self.coef, strict=True)]
        return small_frame(spark, "term string, estimate double", rows)


def solve_symmetric(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Least-squares solution of ``a w = b``, the inverse of ``a``, and its rank.

    Rank is judged on the matrix scaled to unit diagonal.  A deficient system gets the solution of smallest
    norm and no inverse.
    """
    scale = np.sqrt(np.diag(a))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(a / np.outer(scale, scale))
    keep = values > RANK_TOLERANCE * max(values.max(initial=0.0), 1e-300)
    basis = vectors[:, keep]
    inverse = (basis / values[keep]) @ basis.T / np.outer(scale, scale)
    w = inverse @ b
    w = w + inverse @ (b - a @ w)
    if keep.all():
        return w, inverse, len(b)
    null = vectors[:, ~keep] / scale[:, None]
    w = w - null @ np.linalg.lstsq(null, w, rcond=None)[0]
    return w, None, int(keep.sum())


@dataclass(frozen=True)
class OlsFit:
    model: LinearModel
    label: str
    n: float
    rank: int
    intercept: bool
    rss: float
    tss: float
    variance: np.ndarray | None = field(repr=False)  # of the estimates, intercept first, before scaling by s2
    condition: float

    @property
    def df_model(self) -> int:
        return self.rank

    @property
    def df_resid(self) -> float:
        return self.n - self.rank - int(self.intercept)

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss if self.tss > 0 else math.nan

    @property
    def s2(self) -> float:
        return self.rss / self.df_resid if self.df_resid > 0 else math.nan

    def coefficients(self, spark: SparkSession, confidence: float = 0.95) -> DataFrame:
        """One row per term: estimate, standard error, t, p and confidence bounds.

        Under collinearity the estimates are the smallest-norm solution and the inference columns are null.
        """
        names = [t.name for t in self.model.terms]
        estimates = list(map(float, self.model.coef))
        if self.intercept:
            names, estimates = ["_cons", *names], [self.model.intercept, *estimates]
        rows = []
        usable = self.variance is not None and self.df_resid > 0
        reach = dist.t_quantile(0.5 + confidence / 2.0, self.df_resid) if usable else math.nan
        for i, (name, b) in enumerate(zip(names, estimates, strict=True)):
            if not usable:
                rows.append((name, b, None, None, None, None, None))
                continue
            se = math.sqrt(self.s2 * self.variance[i, i])
            t = b / se if se > 0 else None
            p = dist.t_two_sided(t, self.df_resid) if t is not None else None
            rows.append((name, b, se, t, p, b - reach * se, b + reach * se))
        schema = "term string, estimate double, se double, t double, p double, low double, high double"
        return small_frame(spark, schema, rows)

    def statistics(self) -> dict[str, float]:
        """Whole-model statistics, including the analysis of variance."""
        n, dfm, dfr = self.n, self.df_model, self.df_resid
        ess = self.tss - self.rss
        f = (ess / dfm) / self.s2 if dfm > 0 and self.s2 > 0 else math.nan
        parameters = self.rank + int(self.intercept)
        ll = -n / 2.0 * (math.log(2.0 * math.pi) + math.log(self.rss / n) + 1.0) if self.rss > 0 else math.inf
        total_df = n - int(self.intercept)
        return {
            "n": n,
            "df_model": float(dfm),
            "df_resid": float(dfr),
            "ss_model": ess,
            "ss_resid": self.rss,
            "ss_total": self.tss,
            "ms_model": ess / dfm if dfm else math.nan,
            "ms_resid": self.s2,
            "r2": self.r2,
            "r2_adj": 1.0 - (1.0 - self.r2) * total_df / dfr if dfr > 0 else math.nan,
            "f": f,
            "f_p": dist.f_upper(f, dfm, dfr) if f == f else math.nan,
            "root_mse": math.sqrt(self.s2) if self.s2 == self.s2 else math.nan,
            "loglik": ll,
            "aic": -2.0 * ll + 2.0 * parameters,
            "bic": -2.0 * ll + parameters * math.log(n),
            "condition": self.condition,
        }


def fit_moments(moments: Moments, label: str, terms: Sequence[Term], fit_intercept: bool = True) -> OlsFit:
    """OLS of ``label`` on ``terms``.  Without intercept, R-squared is about zero rather than the mean."""
    y = Term(label)
    k = len(terms)
    if fit_intercept:
        mean, cross = moments.at([*terms, y])
    else:
        mean, cross = np.zeros(k + 1), moments.raw([*terms, y])
    xx, xy, tss = cross[:k, :k], cross[:k, k], float(cross[k, k])
    w, inverse, rank = solve_symmetric(xx, xy)
    rss = max(float(tss - 2.0 * w @ xy + w @ xx @ w), 0.0)
    intercept = float(mean[k] - w @ mean[:k]) if fit_intercept else 0.0
    variance = inverse
    if fit_intercept and inverse is not None:
        side = -inverse @ mean[:k]
        corner = 1.0 / moments.n + mean[:k] @ inverse @ mean[:k]
        variance = np.block([[np.array([[corner]]), side[None, :]], [side[:, None], inverse]])
    if fit_intercept:
        sums = moments.n * mean[:k]
        design = np.block([[np.array([[moments.n]]), sums[None, :]], [sums[:, None], moments.raw(terms)]])
    else:
        design = xx
    eigen = np.linalg.eigvalsh(design)
    condition = math.sqrt(eigen[-1] / eigen[0]) if eigen[0] > 0 else math.inf
    model = LinearModel(intercept, tuple(terms), w)
    return OlsFit(model, label, moments.n, rank, fit_intercept, rss, tss, variance, condition)


def ols(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    fit_intercept: bool = True,
) -> OlsFit:
    """Fit on the complete rows of ``df`` in one pass; dummies come after the numeric terms."""
    grams = gram_table(df, [*numeric, label], categorical)
    terms = [Term(c) for c in numeric] + grams.dummies(categorical)
    return fit_moments(grams.moments(), label, terms, fit_intercept)


def elasticity(grams: GramTable, label: str, log_term: str, categorical: Sequence[str]) -> OlsFit:
    """Regression of a log quantity on a log price change and category dummies; the first coefficient is the
    elasticity."""
    return fit_moments(grams.moments(), label, [Term(log_term), *grams.dummies(categorical)])


def with_residuals(df: DataFrame, fit: OlsFit, fitted: str = "fitted", residual: str = "residual") -> DataFrame:
    """Fitted value and residual; null where a regressor or the label is missing."""
    return df.withColumn(fitted, fit.model.predict()).withColumn(
        residual, F.col(fit.label).cast("double") - F.col(fitted)
    )


def vif(spark: SparkSession, moments: Moments, terms: Sequence[Term]) -> DataFrame:
    """Variance inflation per regressor, largest first; null where a regressor is a combination of others."""
    _, scatter = moments.at(terms)
    scale = np.sqrt(np.diag(scatter))
    usable = bool((scale > 0).all())
    correlation = scatter / np.outer(scale, scale) if usable else scatter
    _, inverse, _ = solve_symmetric(correlation, np.zeros(len(terms)))
    rows = [
        (t.name, float(inverse[i, i]), 1.0 / float(inverse[i, i])) if usable and inverse is not None else (t.name, None, None)
        for i, t in enumerate(terms)
    ]
    rows.sort(key=lambda r: (-(r[1] or 0.0), r[0]))
    return small_frame(spark, "term string, vif double, tolerance double", rows)


def mean_vif(table: DataFrame) -> DataFrame:
    return table.agg(F.avg("vif").alias("mean_vif"))


def holdout_metrics(df: DataFrame, label: str, prediction: Column) -> DataFrame:
    """R-squared, mean absolute error and mean squared error over the complete rows, in one pass."""
    y = F.col(label).cast("double")
    rows = complete_cases(df.select(y.alias("y"), prediction.alias("yhat")))
    error = F.col("y") - F.col("yhat")
    return rows.agg(
        F.count("*").alias("n"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop("y") * F.count("*"))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
    )
