"""The three studies from files to reports."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramwise.operators.features import split_group
from gramwise.plans import cross_section as cs
from gramwise.plans import panel as pl
from gramwise.plans.discount import LOG_DISCOUNT, DiscountStudy, read_lines
from gramwise.sources.csv import read_csv, write_csv


@pytest.fixture(scope="module")
def retail(tmp_path_factory):
    rng = np.random.default_rng(21)
    n = 900
    dates = pd.Timestamp("2014-01-03") + pd.to_timedelta(rng.integers(0, 700, n), unit="D")
    frame = pd.DataFrame(
        {
            "Row ID": np.arange(1, n + 1),
            "Order Date": [f"{d.month}/{d.day}/{d.year}" for d in dates],
            "Ship Mode": rng.choice(["First Class", "Same Day"], n),
            "Segment": rng.choice(["Consumer", "Corporate", "Home Office"], n),
            "Region": rng.choice(["East", "West"], n),
            "Sub-Category": rng.choice(["Art", "Binders", "Chairs"], n),
            "Sales": np.round(rng.lognormal(4, 1, n), 2),
            "Discount": rng.choice([0.0, 0.1, 0.2, 0.5, 0.8], n),
            "Unused": "x",
        }
    )
    frame["Profit"] = np.round(frame.Sales * (0.3 - frame.Discount + rng.normal(0, 0.05, n)), 4)
    path = tmp_path_factory.mktemp("retail") / "orders.csv"
    frame.to_csv(path, index=False)
    return frame, str(path)


def test_discount_study(spark, retail, tmp_path):
    frame, path = retail
    lines = read_lines(spark, path, keys={"Row ID": "bigint"})
    assert dict(lines.dtypes)["order_date"] == "date" and "Unused" not in lines.columns
    study = DiscountStudy.fit(lines, split_group(["Row ID"], 5), folds=5)

    parts = {r["Row ID"]: r["part"] for r in lines.select("Row ID", study.part.alias("part")).collect()}
    part = frame["Row ID"].map(parts)
    quarter = pd.to_datetime(frame["Order Date"], format="%m/%d/%Y").dt
    frame = frame.assign(quarter="Q" + quarter.quarter.astype(str) + " " + quarter.year.astype(str))
    columns = ["Sub-Category", "Segment", "Region", "Ship Mode", "quarter"]
    train = frame[part >= 0]
    dummies = pd.concat(
        [(frame[c] == v).astype(float).rename(f"{c}_{v}") for c in columns for v in sorted(train[c].unique())[1:]], axis=1
    )
    margin = frame.Profit / frame.Sales
    design = np.column_stack([np.ones(len(frame)), dummies, frame.Discount])
    expected, *_ = np.linalg.lstsq(design[part >= 0], margin[part >= 0], rcond=None)
    fit = study.ols()
    np.testing.assert_allclose([fit.model.intercept, *fit.model.coef], expected, atol=1e-8)

    held = (part < 0).to_numpy()
    error = margin[held] - design[held] @ expected
    row = study.metrics(lines, fit.model).first()
    assert row["n"] == held.sum()
    assert row["mae"] == pytest.approx(np.abs(error).mean()) and row["mse"] == pytest.approx((error**2).mean())
    assert row["r2"] == pytest.approx(1 - (error**2).sum() / ((margin[held] - margin[held].mean()) ** 2).sum())

    log_design = np.column_stack([np.ones(len(frame)), np.log1p(frame.Discount), dummies])
    log_fit, *_ = np.linalg.lstsq(log_design, np.log(frame.Sales), rcond=None)
    elasticity = study.elasticity().model.coefficient(LOG_DISCOUNT)
    assert elasticity == pytest.approx(log_fit[1], rel=1e-7)

    lasso = study.lasso(n_alphas=30)
    sweep = study.sweep(lines, lasso.model).toPandas()
    at_zero = lasso.model.intercept + dummies.to_numpy() @ lasso.model.coef[:-1]
    cap = 0.2
    new = frame.Discount.clip(upper=cap)
    sales = np.where(frame.Discount > cap, frame.Sales * -elasticity * (new - frame.Discount), frame.Sales)
    profit = ((at_zero + lasso.model.coef[-1] * new) * sales).sum()
    assert sweep.total_profit[20] == pytest.approx(profit, rel=1e-9)
    assert sweep["profit_change_%"][20] == pytest.approx(100 * (profit - frame.Profit.sum()) / frame.Profit.sum())
    best = study.best(lines, lasso.model).first()
    assert best["total_profit"] == sweep.total_profit.max()
    assert best["discount_cap"] == sweep.discount_cap[sweep.total_profit.argmax()]
    curve = study.curve(lines, lasso.model).where("is_max").collect()
    assert [r["discount_cap"] for r in curve] == [best["discount_cap"]]

    write_csv(study.report(lines, lasso.model), str(tmp_path / "sweep"), single_file=True)
    back = read_csv(spark, str(tmp_path / "sweep"), {"discount_cap": "double", "profit_change_$": "double"}).toPandas()
    np.testing.assert_allclose(back.discount_cap, sweep.discount_cap)
    np.testing.assert_allclose(back["profit_change_$"], sweep["profit_change_$"], atol=0.00501)


def test_panel_study(spark, tmp_path):
    rng = np.random.default_rng(3)
    countries, years = [f"Land {i}" for i in range(30)], range(2009, 2023)
    macro = pd.DataFrame([(c, y) for c in countries for y in years], columns=["country_name", "year"])
    n = len(macro)
    for name in pl.REGRESSORS:
        macro[name] = rng.normal(size=n)
    macro["extra"] = rng.normal(size=n)
    macro["income_group"] = rng.choice([*pl.INCOME_CODES, "Not classified"], n)
    macro["country_code"], macro["region"], macro["currency_unit"] = "c", "r", "u"
    macro["years_since_2000"], macro["years_since_century"] = macro.year - 2000, macro.year - 1900
    macro.loc[5, "extra"] = np.nan
    score = macro[["year", "country_name"]].assign(z=3 + macro.gdp_usd - 0.5 * macro.extra.fillna(0) + rng.normal(0, 0.2, n))
    macro.to_csv(tmp_path / "macro.csv", index=False, na_rep="NA")
    score.iloc[: n - 4].rename(columns={"z": "Life, ladder"}).to_csv(tmp_path / "score.csv", index=False)

    panel = pl.build_panel(
        pl.read_macro(spark, str(tmp_path / "macro.csv")), pl.read_score(spark, str(tmp_path / "score.csv")), 2011, 2020
    ).persist()
    assert panel.count() == 298  # two of the four rows without a score are in the range
    assert "income_group" not in panel.columns and panel.where("income_group_code is null").count() > 0
    names = [r["Country"] for r in pl.in_country_order(panel).collect()]
    assert names == sorted(names)

    fit = pl.one_year_ols(panel, 2018)
    rows = panel.where("Year = 2018").toPandas()
    expected, *_ = np.linalg.lstsq(rows[list(pl.REGRESSORS)].to_numpy(), rows.score, rcond=None)
    np.testing.assert_allclose(fit.model.coef, expected, atol=1e-8)

    features = pl.model_columns(panel)
    assert features == [*pl.REGRESSORS, "extra", "income_group_code"]
    parts = pl.split_panel(panel, 4)
    assert parts.count() == panel.where("income_group_code is not null and extra is not null").count()
    lasso = pl.panel_lasso(parts, features, 4)
    chosen = [r["variable"] for r in lasso.selected(spark).collect()]
    assert chosen[:2] == ["gdp_usd", "extra"]
    test = parts.where("part < 0").select("score", lasso.model.predict().alias("p"))
    assert test.agg(F.avg(F.pow(F.col("score") - F.col("p"), 2))).first()[0] < 0.1


def test_cross_section_study(spark):
    rng = np.random.default_rng(4)
    n = 300
    frame = pd.DataFrame({c: rng.uniform(1, 5, n) for c in cs.SUMMARY})
    frame["gdp_percapita"] = rng.uniform(1000, 60000, n)
    frame.loc[:3, "grants_patents"] = [0.0, np.nan, 2.0, 3.0]
    from gramwise.operators.prepare import nan_to_null

    df = cs.derive(nan_to_null(spark.createDataFrame(frame)))
    full, reduced = cs.CrossSectionModel.estimate(df), cs.CrossSectionModel.estimate(df, cs.REDUCED)
    assert full.fit.n == reduced.fit.n == n - 2  # log of zero and missing patents
    used = frame.iloc[2:]
    gdp = used.gdp_percapita / 1000
    design = np.column_stack([np.ones(n - 2), used[list(cs.FULL[:4])], gdp, used.trade_pc_gdp, gdp * used.trade_pc_gdp])
    expected, *_ = np.linalg.lstsq(design, np.log(used.grants_patents / used.population_mil), rcond=None)
    np.testing.assert_allclose([full.fit.model.intercept, *full.fit.model.coef], expected, rtol=1e-6, atol=1e-10)
    inflation = {r["term"]: r["vif"] for r in full.vif(df).collect()}
    smaller = {r["term"]: r["vif"] for r in reduced.vif(df).collect()}
    assert min(inflation.values()) >= 1 and inflation["trade_pc_gdp"] > 3 * smaller["trade_pc_gdp"]
