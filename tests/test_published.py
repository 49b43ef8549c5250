"""Results that are printed in manuals and papers."""

import pytest
from pyspark.sql import functions as F

from gramwise.operators import diagnose, summary
from gramwise.operators.gram import Term, gram_table
from gramwise.operators.ols import fit_moments, ols, vif

REGRESSORS = ["weight", "foreign", "mpg", "foreign_mpg"]


def _model(cars):
    moments = gram_table(cars, [*REGRESSORS, "price"]).moments()
    return moments, fit_moments(moments, "price", [Term(c) for c in REGRESSORS])


def test_summary(cars):
    rows = {r["variable"]: r for r in summary.summarize(cars, ["price", "mpg", "weight"]).collect()}
    assert rows["price"]["obs"] == 74
    assert rows["price"]["mean"] == pytest.approx(6165.257, abs=5e-4)
    assert rows["price"]["sd"] == pytest.approx(2949.496, abs=5e-4)
    assert rows["mpg"]["sd"] == pytest.approx(5.785503, abs=5e-7)
    assert rows["weight"]["sd"] == pytest.approx(777.1936, abs=5e-5)


def test_regression_table(spark, cars):
    fit = ols(cars, "mpg", ["weight", "foreign"])
    rows = {r["term"]: r for r in fit.coefficients(spark).collect()}
    assert rows["weight"]["estimate"] == pytest.approx(-0.0065879, abs=5e-8)
    assert rows["weight"]["se"] == pytest.approx(0.0006371, abs=5e-8)
    assert rows["foreign"]["estimate"] == pytest.approx(-1.650029, abs=5e-7)
    assert rows["foreign"]["se"] == pytest.approx(1.075994, abs=5e-7)
    assert rows["foreign"]["t"] == pytest.approx(-1.53, abs=5e-3)
    assert rows["foreign"]["p"] == pytest.approx(0.130, abs=5e-4)
    assert rows["foreign"]["low"] == pytest.approx(-3.7955, abs=5e-5)
    assert rows["foreign"]["high"] == pytest.approx(0.4954422, abs=5e-6)
    assert rows["_cons"]["estimate"] == pytest.approx(41.6797, abs=5e-5)
    assert rows["_cons"]["se"] == pytest.approx(2.165547, abs=5e-7)
    stats = fit.statistics()
    assert stats["r2"] == pytest.approx(0.6627, abs=5e-5)
    assert stats["r2_adj"] == pytest.approx(0.6532, abs=5e-5)
    assert stats["f"] == pytest.approx(69.75, abs=5e-3)
    assert stats["root_mse"] == pytest.approx(3.4071, abs=5e-5)
    assert stats["ss_model"] == pytest.approx(1619.2877, abs=5e-3)


def test_information_matrix(cars):
    moments, fit = _model(cars)
    rows = {r["source"]: r for r in diagnose.im_test(cars, fit, moments).collect()}
    assert rows["heteroskedasticity"]["chi2"] == pytest.approx(18.86, abs=5e-3)
    assert rows["heteroskedasticity"]["df"] == 10
    assert rows["heteroskedasticity"]["p"] == pytest.approx(0.0420, abs=5e-5)
    assert rows["skewness"]["chi2"] == pytest.approx(11.69, abs=5e-3)
    assert rows["skewness"]["df"] == 4
    assert rows["kurtosis"]["chi2"] == pytest.approx(2.33, abs=5e-3)
    assert rows["total"]["chi2"] == pytest.approx(32.87, abs=5e-3)
    assert rows["total"]["df"] == 15


def test_shapiro_wilk(cars):
    row = diagnose.shapiro_wilk(cars, "mpg").first()
    assert row["w"] == pytest.approx(0.94821, abs=5e-6)
    assert row["v"] == pytest.approx(3.335, abs=5e-4)
    assert row["z"] == pytest.approx(2.627, abs=5e-4)
    assert row["p"] == pytest.approx(0.00430, abs=5e-6)


def test_shapiro_wilk_weights_of_men(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = diagnose.shapiro_wilk(spark.createDataFrame([(float(w),) for w in weights], "x double"), "x").first()
    assert row["w"] == pytest.approx(0.78881, abs=5e-5)
    assert row["p"] == pytest.approx(0.006704, abs=5e-6)


def test_shapiro_francia(cars):
    row = diagnose.shapiro_francia(cars, "mpg").first()
    assert row["w"] == pytest.approx(0.94872, abs=5e-6)
    assert row["z"] == pytest.approx(2.510, abs=5e-4)
    assert row["p"] == pytest.approx(0.00604, abs=5e-6)


def test_vif_is_the_inverse_of_the_unexplained_share(spark, cars):
    moments, _ = _model(cars)
    rows = {r["term"]: r["vif"] for r in vif(spark, moments, [Term("weight"), Term("foreign")]).collect()}
    r = cars.select(F.corr("weight", "foreign")).first()[0]
    assert rows["weight"] == pytest.approx(1 / (1 - r * r)) == pytest.approx(rows["foreign"])
