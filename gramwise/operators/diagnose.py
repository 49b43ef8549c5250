"""Residual diagnostics: moments, normality, heteroskedasticity, density and plot data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.functions import distributions as dist
from gramwise.functions.columns import bucket_above, normal_quantile
from gramwise.operators.cache import kept
from gramwise.operators.gram import Moments, Term, batch_gram
from gramwise.operators.ols import OlsFit, fit_moments, with_residuals
from gramwise.operators.order import quantiles, value_ranks, ROWS_PER_BIN
from gramwise.operators.prepare import complete_cases
from gramwise.operators.report import small_frame


def residual_shape(df: DataFrame, residual: str = "residual") -> dict[str, float]:
    """Skewness, kurtosis (3 for a normal), Jarque–Bera and the omnibus test of D'Agostino and Pearson."""
    row = df.agg(
        F.count(residual).alias("n"), F.skewness(residual).alias("skew"), F.kurtosis(residual).alias("excess")
    ).first()
    n, skew, kurtosis = float(row["n"]), row["skew"], row["excess"] + 3.0
    jb = n / 6.0 * (skew**2 + (kurtosis - 3.0) ** 2 / 4.0)
    out = {"n": n, "skew": skew, "kurtosis": kurtosis, "jarque_bera": jb, "jarque_bera_p": dist.chi2_upper(jb, 2)}
    if n >= 8:
        omnibus = _skew_score(skew, n) ** 2 + _kurtosis_score(kurtosis, n) ** 2
        out |= {"omnibus": omnibus, "omnibus_p": dist.chi2_upper(omnibus, 2)}
    return out


def _skew_score(skew: float, n: float) -> float:
    """D'Agostino's transformation of the skewness to a standard normal."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    spread = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (spread - 1)) - 1
    return math.asinh(y * math.sqrt((w2 - 1) / 2)) / math.sqrt(0.5 * math.log(w2))


def _kurtosis_score(kurtosis: float, n: float) -> float:
    """Anscombe and Glynn's transformation of the kurtosis to a standard normal."""
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis - expected) / math.sqrt(variance)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + math.sqrt(1 + 4 / third**2))
    base = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    return (1 - 2 / (9 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))


def im_test(df: DataFrame, fit: OlsFit, moments: Moments) -> DataFrame:
    """Information-matrix test split into heteroskedasticity, skewness and kurtosis (Cameron and Trivedi).

    Three auxiliary regressions from one cross-product matrix: the squared residual on the regressors, their
    squares and products; the third-order residual term on the regressors; the fourth-order term on a
    constant.  Each statistic is n times the R-squared about zero.  Regressors are standardised first, which leaves the statistics unchanged and the products well
    scaled.  Products that repeat another column do not count as degrees of freedom.
    """
    terms = list(fit.model.terms)
    if any(t.value is not None for t in terms):
        raise ValueError("give indicator columns as numeric regressors")
    mean, scatter = moments.at(terms)
    sd = np.sqrt(np.diag(scatter) / moments.n)
    sd = np.where(sd > 0, sd, 1.0)
    sigma = math.sqrt(fit.rss / fit.n)
    k = len(terms)
    first, second = np.array(list(combinations_with_replacement(range(k), 2))).T
    single = [f"z{i}" for i in range(k)]
    double = [f"z{i}_{j}" for i, j in zip(first, second, strict=True)]

    def derive(x: np.ndarray) -> np.ndarray:
        z, u = (x[:, :k] - mean) / sd, x[:, k:] / sigma
        u2 = u * u
        return np.hstack([z, z[:, first] * z[:, second], u2 - 1.0, u * (u2 - 3.0), u2 * (u2 - 6.0) + 3.0])

    rows = with_residuals(df, fit, "__fitted", "__e").select(
        F.lit(0).alias("__group"), *[F.col(t.column).cast("double").alias(t.column) for t in terms], "__e"
    )
    names = [*single, *double, "second", "third", "fourth"]
    grams = batch_gram(
        complete_cases(rows), [*[t.column for t in terms], "__e"], names, derive, np.zeros(len(names))
    ).moments()
    linear = [Term(c) for c in single]
    hetero = fit_moments(grams, "second", [*linear, *map(Term, double)])
    skew = fit_moments(grams, "third", linear)
    mean, squares = grams.at([Term("third"), Term("fourth")])
    about_zero = np.diag(squares) + grams.n * mean**2
    parts = [
        ("heteroskedasticity", grams.n * hetero.r2, hetero.rank),
        ("skewness", grams.n * (1.0 - skew.rss / about_zero[0]), skew.rank),
        ("kurtosis", grams.n * grams.n * mean[1] ** 2 / about_zero[1], 1),
    ]
    parts.append(("total", sum(p[1] for p in parts), sum(p[2] for p in parts)))
    rows = [(name, x, k, dist.chi2_upper(x, k)) for name, x, k in parts]
    return small_frame(df.sparkSession, "source string, chi2 double, df int, p double", rows)


def density(df: DataFrame, column: str = "residual", points: int = 50) -> DataFrame:
    """Epanechnikov kernel density on an even grid, with the normal density of the same mean and sd.

    The bandwidth is 0.9 min(sd, IQR / 1.349) n^(-1/5); the grid has at most ``points`` points and reaches one
    bandwidth beyond the data.  The kernel is a parabola with bounded support, so the density at a point needs
    only the count, mean and variance of the rows within its reach.  Rows are summed once into the intervals
    between the ends of all the supports; no row meets a grid point.
    """
    with kept(complete_cases(df.select(F.col(column).cast("double").alias("x")))) as x:
        row = x.agg(
            F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
            F.min("x").alias("low"), F.max("x").alias("high"),
        ).first()
        n, mean, sd = row["n"], row["mean"], row["sd"]
        if n < 2 or not sd > 0:
            raise ValueError("a density needs values that differ")
        q1, q3 = quantiles(x, "x", n, [0.25, 0.75])
        spread = min(sd, (q3 - q1) / 1.349)
        h = 0.9 * (spread if spread > 0 else sd) * n**-0.2
        count = min(points, n)
        grid = row["low"] - h + np.arange(count) * ((row["high"] - row["low"] + 2.0 * h) / (count - 1))
        reach = h * math.sqrt(5.0)
        cuts = sorted({*map(float, grid - reach), *map(float, grid + reach)})
        bins = (
            bucket_above(x, "x", cuts, "bin")
            .groupBy("bin")
            .agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
            .collect()
        )
    index = np.array([b["bin"] for b in bins])
    bin_n, bin_mean, bin_var = (np.array([float(b[k]) for b in bins]) for k in ("n", "mean", "var"))
    position = {c: i for i, c in enumerate(cuts)}
    rows = []
    normal = NormalDist(mean, sd)
    for g in map(float, grid):
        inside = (index > position[g - reach]) & (index <= position[g + reach])
        square = bin_var[inside] + (bin_mean[inside] - g) ** 2
        kernel = np.sum(bin_n[inside] * (1.0 - square / (5.0 * h * h))) * 0.75 / math.sqrt(5.0)
        rows.append((g, float(max(kernel, 0.0) / (n * h)), normal.pdf(g)))
    return small_frame(df.sparkSession, "point double, density double, normal double", rows)


# Royston's polynomials for the Shapiro–Wilk weights and p-value (algorithm AS R94).  Fixed values.
_WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_WEIGHT_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_GAMMA = (-2.273, 0.459)
_SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients: Sequence[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def normal_scores(df: DataFrame, column: str, rows_per_bin: int = ROWS_PER_BIN) -> dict:
    """What the tests need of the ordered sample: sums over all rows of the normal score (``m``), its square
    and its product with the centred value, and both at the two smallest and the two largest ranks.

    Equal values share the score of their mean rank, so one row per distinct value is enough.
    """
    with kept(complete_cases(df.select(F.col(column).cast("double").alias("x")))) as x:
        head = x.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).first()
        n, mean = head["n"], head["mean"]
        if n < 4:
            raise ValueError("at least four values are needed")
        if not head["var"] > 0:
            raise ValueError("all values are equal")
        mean_rank = F.col("before") + (F.col("n") + 1) / 2.0
        score = normal_quantile((mean_rank - F.lit(0.375)) / F.lit(n + 0.25))
        ranked = value_ranks(x, "x", rows=n, rows_per_bin=rows_per_bin).select(
            "n", "before", score.alias("m"), (F.col("value") - F.lit(mean)).alias("d")
        )
        count, m, d = F.col("n"), F.col("m"), F.col("d")
        ends = {}
        for rank in (1, 2, n - 1, n):
            here = (F.col("before") < rank) & (F.col("before") + count >= rank)
            ends[rank] = F.max(F.when(here, F.struct(m, d))).alias(f"end{rank}")
        row = ranked.agg(
            F.sum(count * m).alias("m"), F.sum(count * m * m).alias("mm"), F.sum(count * m * d).alias("md"),
            *ends.values(),
        ).first()
    return {
        "n": n, "spread": head["var"] * n, "m": row["m"], "mm": row["mm"], "md": row["md"],
        "ends": [tuple(row[f"end{rank}"]) for rank in ends],
    }


def shapiro_wilk(df: DataFrame, column: str = "residual") -> DataFrame:
    """W, V, z and p of the Shapiro–Wilk test, with mean ranks for ties.

    The p-value is calibrated for 4 to 2000 values; beyond that V, z and p are null and ``shapiro_francia``
    should be read instead.
    """
    s = normal_scores(df, column)
    n, ends = s["n"], s["ends"]
    root = math.sqrt(s["mm"])
    last = _poly(_WEIGHT_LAST, n**-0.5) + ends[3][0] / root
    second = _poly(_WEIGHT_NEXT, n**-0.5) + ends[2][0] / root
    if n > 5:
        weights = {0: -last, 1: -second, 2: second, 3: last}
        norm = (s["mm"] - 2 * ends[3][0] ** 2 - 2 * ends[2][0] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    else:
        weights = {0: -last, 3: last}
        norm = (s["mm"] - 2 * ends[3][0] ** 2) / (1 - 2 * last**2)
    # Every row weighs m / sqrt(norm), but for the rows at the ends.
    a, aa, ad = s["m"] / math.sqrt(norm), s["mm"] / norm, s["md"] / math.sqrt(norm)
    for i, weight in weights.items():
        usual = ends[i][0] / math.sqrt(norm)
        a += weight - usual
        aa += weight**2 - usual**2
        ad += (weight - usual) * ends[i][1]
    w = min(ad**2 / ((aa - a * a / n) * s["spread"]), 1.0)
    v = z = p = None
    if n <= 2000 and w < 1.0:
        v, z = _shapiro_wilk_score(w, n)
        p = dist.normal_upper(z)
    return small_frame(df.sparkSession, "n bigint, w double, v double, z double, p double", [(n, w, v, z, p)])


def _shapiro_wilk_score(w: float, n: int) -> tuple[float, float]:
    gap = math.log(1.0 - w)
    if n <= 11:
        gap = -math.log(_poly(_SMALL_GAMMA, n) - gap)
        mean, sd = _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_LOG_SD, n))
    else:
        mean, sd = _poly(_LARGE_MEAN, math.log(n)), math.exp(_poly(_LARGE_LOG_SD, math.log(n)))
    return math.exp(gap - mean), (gap - mean) / sd


def shapiro_francia(df: DataFrame, column: str = "residual", rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """W' (squared correlation with the normal scores), z and p after Royston (1993).

    ``calibrated`` says whether the number of values is in the published range, 5 to 5000, in which z and p are given.
    """
    s = normal_scores(df, column, rows_per_bin)
    n = s["n"]
    w = s["md"] ** 2 / ((s["mm"] - s["m"] ** 2 / n) * s["spread"])
    z = p = None
    if 5 <= n <= 5000 and w < 1.0:
        u = math.log(n)
        v = math.log(u)
        mean, sd = -1.2725 + 1.0521 * (v - u), 1.0308 - 0.26758 * (v + 2.0 / u)
        z = (math.log(1.0 - w) - mean) / sd
        p = dist.normal_upper(z)
    fields = "n bigint, w double, z double, p double, calibrated boolean"
    return small_frame(df.sparkSession, fields, [(n, w, z, p, 5 <= n <= 5000)])


def binned_pairs(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Counts of (x, y) on an even grid of cells: the data of a scatter plot of any number of rows.

    Every row carries the extents of both axes, from which a chart draws its zero line or diagonal.
    """
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pairs = complete_cases(pairs)
    e = pairs.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if e["x0"] is None:
        raise ValueError("no complete pairs")

    def cell(axis: str):
        low, high = e[f"{axis}0"], e[f"{axis}1"]
        width = (high - low) / bins or 1.0
        return F.least(F.floor((F.col(axis) - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1)).alias(f"{axis}_bin")

    extents = [F.lit(e[k]).alias(name) for k, name in (("x0", "x_min"), ("x1", "x_max"), ("y0", "y_min"), ("y1", "y_max"))]
    return pairs.groupBy(cell("x"), cell("y")).agg(F.count("*").alias("n")).select("x_bin", "y_bin", "n", *extents)
