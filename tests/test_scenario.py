import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramwise.operators.gram import Term
from gramwise.operators.ols import LinearModel
from gramwise.operators.scenario import best_cap, cap_grid, cap_sweep, capped_rows, constant_margin, profit_curve

MODEL = LinearModel(0.4, (Term("g", "b"), Term("discount")), np.array([0.05, -1.3]))


def _frame(n=500, seed=2, distinct=False):
    rng = np.random.default_rng(seed)
    discount = rng.choice([0.0, 0.05, 0.2, 0.37], n) if distinct else np.clip(rng.uniform(-0.1, 0.95, n), 0, None)
    sales = rng.uniform(1, 900, n)
    return pd.DataFrame(
        {"discount": discount, "sales": sales, "profit": sales * rng.uniform(-0.2, 0.4, n), "g": rng.choice(["a", "b", "c"], n)}
    )


def _by_rows(frame, caps, elasticity, mode):
    out = []
    for cap in caps:
        new = frame.discount.clip(upper=cap)
        margin = 0.4 + 0.05 * (frame.g == "b") - 1.3 * new
        response = -elasticity * (new - frame.discount)
        factor = response if mode == "level" else 1 + response
        sales = np.where(frame.discount > cap, frame.sales * factor, frame.sales)
        out.append((cap, (margin * sales).sum(), sales.sum()))
    return np.array(out)


@pytest.mark.parametrize("mode", ["level", "relative"])
@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("elasticity", [-0.8, 0.6])
def test_sweep_equals_the_row_model(spark, mode, distinct, elasticity):
    frame = _frame(distinct=distinct)
    df = spark.createDataFrame(frame).repartition(5)
    rows = cap_sweep(df, cap_grid(), MODEL, elasticity, mode=mode).collect()
    expected = _by_rows(frame, cap_grid(), elasticity, mode)
    assert [r["discount_cap"] for r in rows] == list(expected[:, 0])
    np.testing.assert_allclose([r["total_profit"] for r in rows], expected[:, 1], rtol=1e-10, atol=1e-7)
    np.testing.assert_allclose([r["total_sales"] for r in rows], expected[:, 2], rtol=1e-10, atol=1e-7)
    base = frame.profit.sum()
    np.testing.assert_allclose([r["profit_change_%"] for r in rows], 100 * (expected[:, 1] - base) / base, rtol=1e-9)
    sales = frame.sales.sum()
    np.testing.assert_allclose([r["sales_change_%"] for r in rows], 100 * (expected[:, 2] - sales) / sales, atol=1e-9)

    one = capped_rows(df, 0.2, MODEL, elasticity, mode=mode).agg(F.sum("predicted_profit"), F.sum("predicted_sales")).first()
    np.testing.assert_allclose(list(one), expected[20, 1:], rtol=1e-10)


def test_unordered_uneven_caps(spark):
    frame = _frame()
    caps = [0.5, 0.033, 0.9999, 0.1]
    rows = cap_sweep(spark.createDataFrame(frame), caps, MODEL, -0.8).collect()
    expected = _by_rows(frame, sorted(caps), -0.8, "level")
    np.testing.assert_allclose([r["total_profit"] for r in rows], expected[:, 1], rtol=1e-10, atol=1e-7)


def test_cap_above_every_discount_keeps_sales(spark):
    frame = _frame(distinct=True)
    row = cap_sweep(spark.createDataFrame(frame), [0.37, 0.8], MODEL, -0.8).collect()
    assert [r["total_sales"] for r in row] == pytest.approx([frame.sales.sum()] * 2, rel=1e-14)
    assert row[0]["total_profit"] == row[1]["total_profit"]


def test_level_mode_turns_sales_negative_with_a_negative_elasticity(spark):
    df = spark.createDataFrame([(100.0, 0.5, 10.0)], "sales double, discount double, profit double")
    row = cap_sweep(df, [0.2], constant_margin(0.0, 1.0), -1.0).first()
    assert row["total_sales"] == pytest.approx(-30.0)
    assert cap_sweep(df, [0.2], constant_margin(0.0, 1.0), -1.0, mode="relative").first()["total_sales"] == pytest.approx(70.0)


def test_rows_without_inputs_are_counted(spark):
    df = spark.createDataFrame(
        [(100.0, 0.1, 10.0), (50.0, None, 5.0), (None, 0.1, 2.0)], "sales double, discount double, profit double"
    )
    rows = cap_sweep(df, [0.0, 0.2], constant_margin(-1.0, 0.5), -0.5).collect()
    assert [r["n_null"] for r in rows] == [2, 2]
    assert rows[1]["total_sales"] == pytest.approx(100.0)
    assert rows[1]["sales_change_%"] == pytest.approx(100 * (100 - 150) / 150)


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    rows = [(100.0, 0.1, 10.0), (50.0, nan, 5.0), (nan, 0.1, 2.0), (30.0, 0.0, nan)]
    df = spark.createDataFrame(rows, "sales double, discount double, profit double")
    row = cap_sweep(df, [0.2], constant_margin(-1.0, 0.5), -0.5).first()
    assert row["n_null"] == 2 and row["total_sales"] == pytest.approx(130.0)
    assert row["profit_change_$"] == pytest.approx(100 * 0.4 + 30 * 0.5 - 17)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "sales double, discount double, profit double")
    rows = cap_sweep(empty, [0.0, 0.1], constant_margin(-1.0, 0.5), -0.5).collect()
    assert [(r["total_profit"], r["profit_change_%"], r["n_null"]) for r in rows] == [(0.0, None, 0)] * 2


def test_best_cap_and_curve(spark):
    sweep = spark.createDataFrame(
        [(0.0, 1.0, 5.0), (0.1, 7.0, 6.0), (0.2, 7.0, 6.0)], "discount_cap double, total_profit double, total_sales double"
    )
    assert tuple(best_cap(sweep).first()) == (0.1, 7.0)
    assert {r["discount_cap"]: r["is_max"] for r in profit_curve(sweep).collect()} == {0.0: False, 0.1: True, 0.2: False}


def test_grid_and_mode_are_checked(spark):
    assert cap_grid()[7] == 0.07 and len(cap_grid()) == 81 and cap_grid()[-1] == 0.8
    with pytest.raises(ValueError):
        cap_grid(0)
    with pytest.raises(ValueError, match="mode"):
        cap_sweep(spark.createDataFrame(_frame(10)), [0.1], MODEL, 1.0, mode="other")
