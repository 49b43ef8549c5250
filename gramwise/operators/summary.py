"""Descriptive aggregates.  Each is a single pass with partial aggregation on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.functions.columns import count_where
from gramwise.operators.prepare import nan_to_null


def summarize(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Obs, mean, standard deviation (n - 1), minimum and maximum; obs counts the non-missing per variable."""
    aggregates = []
    for v in variables:
        x = F.col(v).cast("double")
        aggregates += [
            F.count(x).alias(f"n_{v}"), F.avg(x).alias(f"mean_{v}"), F.stddev_samp(x).alias(f"sd_{v}"),
            F.min(x).alias(f"min_{v}"), F.max(x).alias(f"max_{v}"),
        ]
    wide = nan_to_null(df.select(*variables)).agg(*aggregates)
    rows = ", ".join(f"'{v}', `n_{v}`, `mean_{v}`, `sd_{v}`, `min_{v}`, `max_{v}`" for v in variables)
    return wide.selectExpr(f"stack({len(variables)}, {rows}) as (variable, obs, mean, sd, min, max)")


def baseline_totals(df: DataFrame, profit: str = "profit", sales: str = "sales") -> DataFrame:
    """Total profit, total sales and their ratio (the ratio of sums, not the mean of ratios)."""
    missing = F.col(profit).isNull() | F.col(sales).isNull()
    return nan_to_null(df.select(profit, sales)).agg(
        F.sum(profit).alias("total_profit"),
        F.sum(sales).alias("total_sales"),
        F.try_divide(F.sum(profit), F.sum(sales)).alias("margin"),
        count_where(missing).alias("n_null"),
    )


def discount_notes(df: DataFrame, discount: str = "discount") -> DataFrame:
    return nan_to_null(df.select(discount)).agg(
        F.avg(discount).alias("mean_discount"),
        count_where(F.col(discount) > 0).alias("n_discounted"),
        F.count("*").alias("n_rows"),
    )


def extent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return nan_to_null(df.select(*columns)).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column with their counts, as (variable, category, n)."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return (
        df.selectExpr(f"stack({len(columns)}, {pairs}) as (variable, category)")
        .groupBy("variable", "category")
        .agg(F.count("*").alias("n"))
    )
