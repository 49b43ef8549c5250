"""What-if sweeps of a cap on a price lever."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramwise.functions.columns import bucket_above, cap_above, change, first_max, percent_change
from gramwise.operators.gram import Term
from gramwise.operators.ols import LinearModel
from gramwise.operators.prepare import nan_to_null
from gramwise.operators.report import small_frame

MAX_CAPS = 100_000


def cap_grid(points: int = 81, denominator: int = 100, most: int = MAX_CAPS) -> list[float]:
    """0/denominator, 1/denominator, …: division of integers, so that 0.07 is the double written 0.07."""
    if not 0 < points <= most:
        raise ValueError(f"between 1 and {most} grid points")
    return [k / denominator for k in range(points)]


def capped_rows(
    df: DataFrame,
    cap: float,
    margin: LinearModel,
    elasticity: float,
    sales: str = "sales",
    discount: str = "discount",
    mode: str = "level",
) -> DataFrame:
    """Predicted margin, sales and profit of every row if discounts were capped.

    Rows at or below the cap keep their sales.  In ``level`` mode the sales of a capped row are
    ``sales * (-elasticity * change)``: the response itself, not one plus the response, so a capped row falls to
    a small fraction of its sales, and to negative sales when the elasticity is negative.  ``relative`` mode
    uses ``1 - elasticity * change``.
    """
    _check_mode(mode)
    d = F.col(discount)
    response = F.lit(-float(elasticity)) * F.col("discount_change")
    multiplier = response if mode == "level" else F.lit(1.0) + response
    return (
        df.withColumn("discount_new", cap_above(d, cap))
        .withColumn("discount_change", change(F.col("discount_new"), d))
        .withColumn("predicted_margin", margin.predict({discount: F.col("discount_new")}))
        .withColumn("predicted_sales", F.when(d > F.lit(float(cap)), F.col(sales) * multiplier).otherwise(F.col(sales)))
        .withColumn("predicted_profit", F.col("predicted_margin") * F.col("predicted_sales"))
    )


def cap_sweep(
    df: DataFrame,
    caps: Sequence[float],
    margin: LinearModel,
    elasticity: float,
    sales: str = "sales",
    discount: str = "discount",
    profit: str = "profit",
    mode: str = "level",
    most: int = MAX_CAPS,
) -> DataFrame:
    """Total profit and sales under each cap, with changes against the actual totals.

    The margin is linear in the capped discount, so a cap's totals are polynomials in the cap whose
    coefficients are sums over the rows above it and the rows at or below it.  One pass sums each row into the
    bucket between two neighbouring caps; running sums over the buckets then give every cap.  The work per row
    does not depend on the number of caps, no row is copied, and at most ``len(caps) + 1`` rows are shuffled
    per task.  Rows without sales, discount or predicted margin are counted in ``n_null``.
    """
    _check_mode(mode)
    caps = sorted(set(map(float, caps)))
    if not 0 < len(caps) <= most:
        raise ValueError(f"between 1 and {most} caps")
    slope = sum(float(b) for t, b in zip(margin.terms, margin.coef, strict=True) if t.column == discount)
    s, d, m = F.col("s"), F.col("d"), F.col("m")
    rows = nan_to_null(
        df.select(
            F.col(sales).cast("double").alias("s"),
            F.col(discount).cast("double").alias("d"),
            margin.predict({discount: F.lit(0.0)}).alias("m"),
            F.col(profit).cast("double").alias("actual"),
        )
    )
    usable = s.isNotNull() & d.isNotNull() & m.isNotNull()
    buckets = (
        bucket_above(rows, "d", caps, "k")
        .groupBy(F.when(usable, F.col("k")).alias("k"))
        .agg(
            F.coalesce(F.sum(s), F.lit(0.0)).alias("s0"),
            F.coalesce(F.sum(s * d), F.lit(0.0)).alias("s1"),
            F.coalesce(F.sum(s * m), F.lit(0.0)).alias("m0"),
            F.coalesce(F.sum(s * m * d), F.lit(0.0)).alias("m1"),
            F.coalesce(F.sum("actual"), F.lit(0.0)).alias("actual"),
            F.count("*").alias("n"),
        )
    )
    return _combine(df.sparkSession, buckets, caps, slope, float(elasticity), mode)


def _combine(
    spark: SparkSession, buckets: DataFrame, caps: list[float], slope: float, elasticity: float, mode: str
) -> DataFrame:
    sums = ["s0", "s1", "m0", "m1", "actual"]
    grid = small_frame(spark, "k int, cap double", [*enumerate(caps), (len(caps), None)])
    # From here on there are len(caps) + 2 rows at most: one window over all of them is cheap.
    joined = grid.join(buckets, "k", "full_outer").fillna(0.0, subset=sums).fillna(0, subset=["n"])
    at_or_below = Window.orderBy(F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.col("k").asc_nulls_last()).rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy(F.col("k").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    in_model = {c: F.when(F.col("k").isNotNull(), F.col(c)).otherwise(0.0) for c in sums}
    totals = joined.select(
        "k",
        "cap",
        *[F.sum(in_model[c]).over(at_or_below).alias(f"kept_{c}") for c in ("s0", "s1", "m0", "m1")],
        *[
            F.coalesce(F.sum(in_model[c]).over(above), F.lit(0.0)).alias(f"cut_{c}")
            for c in ("s0", "s1", "m0", "m1")
        ],
        F.sum("actual").over(everything).alias("base_profit"),
        F.sum("s0").over(everything).alias("base_sales"),
        F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)).over(everything).alias("n_null"),
    ).where(F.col("cap").isNotNull())

    c, b, e = F.col("cap"), F.lit(slope), F.lit(-elasticity)
    cut = {name: F.col(f"cut_{name}") for name in ("s0", "s1", "m0", "m1")}
    sales = F.col("kept_s0") + e * (c * cut["s0"] - cut["s1"])
    profit = (
        F.col("kept_m0") + b * F.col("kept_s1")
        + e * (c * cut["m0"] - cut["m1"] + b * c * (c * cut["s0"] - cut["s1"]))
    )
    if mode == "relative":
        sales = sales + cut["s0"]
        profit = profit + cut["m0"] + b * c * cut["s0"]
    return (
        totals.withColumn("total_profit", profit)
        .withColumn("total_sales", sales)
        .select(
            F.col("cap").alias("discount_cap"),
            "total_profit",
            "total_sales",
            change(F.col("total_profit"), F.col("base_profit")).alias("profit_change_$"),
            percent_change(F.col("total_profit"), F.col("base_profit")).alias("profit_change_%"),
            percent_change(F.col("total_sales"), F.col("base_sales")).alias("sales_change_%"),
            "n_null",
        )
        .orderBy("discount_cap")
    )


def best_cap(sweep: DataFrame) -> DataFrame:
    """The cap with the largest total profit, the smallest such cap on a tie; use it on unrounded totals."""
    best = sweep.agg(first_max(F.col("total_profit"), F.col("discount_cap")).alias("best"))
    return best.select(F.col("best.at").alias("discount_cap"), F.col("best.value").alias("total_profit"))


def profit_curve(sweep: DataFrame) -> DataFrame:
    """The sweep with its best cap marked, as a chart would show it (one row per cap)."""
    best = best_cap(sweep).select(F.col("discount_cap"), F.lit(True).alias("is_max"))
    return sweep.join(best, "discount_cap", "left").select(
        "discount_cap", "total_profit", "total_sales", F.coalesce("is_max", F.lit(False)).alias("is_max")
    )


def _check_mode(mode: str) -> None:
    if mode not in ("level", "relative"):
        raise ValueError("mode is 'level' or 'relative'")


def constant_margin(slope: float, intercept: float, discount: str = "discount") -> LinearModel:
    """A margin model with given constants, for sweeps that should not depend on a fit."""
    return LinearModel(float(intercept), (Term(discount),), np.array([float(slope)]))
