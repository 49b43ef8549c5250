"""Country-year panel: one-year regression, Lasso and random forest of a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwise.functions.columns import recode
from gramwise.operators.features import Scaler, split_group
from gramwise.operators.forest import ForestCv, forest_cv
from gramwise.operators.gram import Term, gram_table
from gramwise.operators.lasso import LassoCv, lasso_cv
from gramwise.operators.ols import OlsFit, ols
from gramwise.operators.prepare import (
    complete_cases, inner_join, project_except, rename, rename_by_position, sort_missing_last, within,
)
from gramwise.sources.csv import header, read_csv

# Names, income codes, regressors and exclusions of the panel analysis.
MACRO_NAMES = {"country_name": "Country", "year": "Year"}
INCOME_CODES = {"Low income": 0, "Lower middle income": 1, "Upper middle income": 2, "High income": 3}
REGRESSORS = (
    "gdp_usd", "inflation_rate", "unemployment_rate", "fdi_pct_gdp", "healthcare_capacity_index",
    "digital_connectivity_index", "governance_quality_index",
)
EXCLUDED = ("Year", "Country", "country_code", "region", "currency_unit", "years_since_2000", "years_since_century")


TEXT_COLUMNS = ("country_name", "country_code", "region", "currency_unit", "income_group")


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    """The macro table from CSV: named text columns, the year, and numbers in all other columns."""
    names = header(spark, path)
    return read_csv(
        spark, path, {n: "string" if n in TEXT_COLUMNS else "int" if n == "year" else "double" for n in names}
    )


def read_score(spark: SparkSession, path: str) -> DataFrame:
    """Year, country and score: the first three columns of an exported sheet, whatever their names."""
    return read_csv(spark, path, by_position(header(spark, path)))


def by_position(names: Sequence[str]) -> dict[str, str]:
    """Types of the sheet's three columns under the names they have."""
    return dict(zip(names, ("int", "string", "double"), strict=True))


def prepare_macro(macro: DataFrame, first: int, last: int) -> DataFrame:
    coded = rename(macro, MACRO_NAMES).withColumn("income_group_code", recode(F.col("income_group"), INCOME_CODES))
    return within(coded.drop("income_group"), "Year", first, last)


def prepare_score(sheet: DataFrame, score: str, first: int, last: int) -> DataFrame:
    return within(rename_by_position(sheet, ["Year", "Country", score]), "Year", first, last)


def build_panel(macro: DataFrame, sheet: DataFrame, first: int, last: int, score: str = "score") -> DataFrame:
    """Inner join of both tables on year and country; sort it with ``in_country_order`` to show or write it."""
    return inner_join(
        prepare_macro(macro, first, last), prepare_score(sheet, score, first, last), ["Year", "Country"]
    )


def in_country_order(panel: DataFrame) -> DataFrame:
    return sort_missing_last(panel, "Country", "Year")


def one_year_ols(panel: DataFrame, year: int, score: str = "score", regressors: Sequence[str] = REGRESSORS) -> OlsFit:
    """Regression through the origin for one year."""
    return ols(panel.where(F.col("Year") == year), score, regressors, fit_intercept=False)


def model_columns(panel: DataFrame, score: str = "score") -> list[str]:
    """Every numeric column that is not excluded."""
    return project_except(panel, [*EXCLUDED, score]).columns


def model_rows(panel: DataFrame, score: str = "score") -> DataFrame:
    """Rows with the label and all features present; the label travels with its features."""
    return complete_cases(panel, [score, *model_columns(panel, score)])


def split_panel(panel: DataFrame, folds: int, percent: int = 20, score: str = "score") -> DataFrame:
    """Complete rows with ``part``: -1 for the test rows, else the fold, by a hash of country and year."""
    return model_rows(panel, score).withColumn("part", split_group(["Country", "Year"], folds, percent))


def scaled_split(parts: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features standardised with the means and deviations of the training rows."""
    return Scaler.fit(parts.where(F.col("part") >= 0), features).transform(parts)


def panel_lasso(parts: DataFrame, features: Sequence[str], folds: int, score: str = "score") -> LassoCv:
    grams = gram_table(parts, [*features, score], group=F.col("part"))
    return lasso_cv(grams, score, [Term(c) for c in features], range(folds), standardize=True)


def panel_forest(
    parts: DataFrame, features: Sequence[str], folds: int, trees: Sequence[int], score: str = "score", **options
) -> ForestCv:
    train = scaled_split(parts, features).where(F.col("part") >= 0)
    return forest_cv(train, score, features, "part", ["Country", "Year"], folds, trees=trees, **options)
