"""Discount what-if: margin models, elasticity and a sweep of discount caps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwise.functions.columns import log_positive, parse_date, quarter_label, ratio, round_half_even
from gramwise.operators.gram import GramTable, Term, gram_table
from gramwise.operators.lasso import LassoCv, lasso_cv
from gramwise.operators.ols import LinearModel, OlsFit, elasticity, fit_moments, holdout_metrics
from gramwise.operators.report import small_frame
from gramwise.operators.scenario import best_cap, cap_grid, cap_sweep, profit_curve
from gramwise.sources.csv import read_csv

LOG_DISCOUNT = "log1p_discount"
LOG_SALES = "log_sales"


# The columns of the retail file, their types and their names here.
RETAIL_COLUMNS = {
    "Order Date": ("string", "order_date"),
    "Sales": ("double", "sales"),
    "Profit": ("double", "profit"),
    "Discount": ("double", "discount"),
    "Sub-Category": ("string", "sub_category"),
    "Segment": ("string", "segment"),
    "Region": ("string", "region"),
    "Ship Mode": ("string", "ship_mode"),
}
CATEGORIES = ("sub_category", "segment", "region", "ship_mode", "quarter")


def read_lines(
    spark: SparkSession, path: str, keys: Mapping[str, str] | None = None, date_format: str = "M/d/yyyy"
) -> DataFrame:
    """Order lines from CSV with their quarter and margin.  ``keys`` names further columns to keep, with types."""
    types = {name: kind for name, (kind, _) in RETAIL_COLUMNS.items()} | dict(keys or {})
    lines = read_csv(spark, path, types).withColumnsRenamed({n: to for n, (_, to) in RETAIL_COLUMNS.items()})
    return lines.withColumn("order_date", parse_date(F.col("order_date"), date_format)).withColumns(
        {"quarter": quarter_label(F.col("order_date")), "margin": ratio(F.col("profit"), F.col("sales"))}
    )


@dataclass(frozen=True)
class DiscountStudy:
    """Models of the margin and of log sales, all fitted from one pass over the order lines.

    The margin models learn from the training rows, the elasticity from all rows.  ``part`` tells them apart: -1
    for a test row, else the fold (see ``split_group``).  It takes the place of a shuffle of row
    numbers: the same rows are in the test part for any partitioning, but they are not the rows that another
    library's random split would pick.
    """

    part: Column
    categorical: tuple[str, ...]
    grams: GramTable
    folds: tuple[int, ...]

    @classmethod
    def fit(
        cls, lines: DataFrame, part: Column, categorical: Sequence[str] = CATEGORIES, folds: int = 15
    ) -> DiscountStudy:
        numeric = ["discount", LOG_DISCOUNT, "margin", LOG_SALES]
        grams = gram_table(with_logs(lines), numeric, categorical, part)
        return cls(part, tuple(categorical), grams, tuple(range(folds)))

    @property
    def terms(self) -> list[Term]:
        """Dummies of the categories seen in training, then the discount."""
        return [*self.grams.dummies(self.categorical, self.folds), Term("discount")]

    def ols(self) -> OlsFit:
        return fit_moments(self.grams.moments(self.folds), "margin", self.terms)

    def lasso(self, n_alphas: int = 100) -> LassoCv:
        return lasso_cv(self.grams, "margin", self.terms, self.folds, n_alphas=n_alphas)

    def elasticity(self) -> OlsFit:
        return elasticity(self.grams, LOG_SALES, LOG_DISCOUNT, self.categorical)

    def elasticity_value(self) -> float:
        return self.elasticity().model.coefficient(LOG_DISCOUNT)

    def metrics(self, lines: DataFrame, model: LinearModel) -> DataFrame:
        """Test metrics on the rows that the fit did not see."""
        held_out = with_logs(lines).where(self.part == -1)
        return holdout_metrics(held_out, "margin", model.predict())

    def sweep(
        self, lines: DataFrame, model: LinearModel, caps: Sequence[float] | None = None, mode: str = "level"
    ) -> DataFrame:
        return cap_sweep(lines, caps or cap_grid(), model, self.elasticity_value(), mode=mode)

    def report(self, lines: DataFrame, model: LinearModel, mode: str = "level") -> DataFrame:
        """The sweep as it is written to a file: six columns, rounded to two digits."""
        return round_half_even(self.sweep(lines, model, mode=mode).drop("n_null"), 2)

    def best(self, lines: DataFrame, model: LinearModel, mode: str = "level") -> DataFrame:
        return best_cap(self.sweep(lines, model, mode=mode))

    def curve(self, lines: DataFrame, model: LinearModel) -> DataFrame:
        return profit_curve(self.sweep(lines, model))

    def elasticity_table(self, lines: DataFrame) -> DataFrame:
        fit = self.elasticity()
        return small_frame(
            lines.sparkSession, "elasticity double, n bigint", [(fit.model.coefficient(LOG_DISCOUNT), fit.n)]
        )


def with_logs(lines: DataFrame) -> DataFrame:
    """Log sales and log(1 + discount).  Margin and log sales need positive sales; other rows get null there
    and are left out of the fits."""
    return lines.withColumns(
        {
            LOG_DISCOUNT: F.log1p(F.col("discount")),
            LOG_SALES: log_positive(F.col("sales")),
            "margin": F.when(F.col("sales") > 0, F.col("margin")),
        }
    )
