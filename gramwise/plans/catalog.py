"""The registered queries: every operator over the whole tables, rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwise.functions.columns import parse_date, quarter_label, ratio, round_half_even
from gramwise.operators import diagnose, features, order, scenario, summary
from gramwise.operators.cache import kept
from gramwise.operators.forest import FULL_TREES, oob_error, out_of_bag
from gramwise.operators.gram import Term, gram_table
from gramwise.operators.iterative import ols_many_levels
from gramwise.operators.lasso import lasso, lasso_cv
from gramwise.operators.ols import fit_moments, mean_vif, ols, vif, with_residuals
from gramwise.operators.ols import holdout_metrics as metrics_of
from gramwise.operators.prepare import by_magnitude, missing_report, top_k
from gramwise.operators.qr import least_squares
from gramwise.operators.report import small_frame, statistics_frame
from gramwise.plans import cross_section as cs
from gramwise.plans import panel as pl
from gramwise.plans.discount import DiscountStudy
from gramwise.sources import csv as text
from gramwise.sources.tables import SALES_CATEGORIES, SALES_KEYS, cross_section, macro_table, sales, score_table

Query = Callable[[SparkSession, str], DataFrame]

FOLDS = 15
PANEL_YEARS = (1995, 2001)
PANEL_FOLDS = 10
# Rows of a range in the registered rank queries: small, so that tables of any size are cut into many.
SMALL_RANGE = 5_000
ONE_YEAR = 1999
# Given constants of the sweep without a fit; many digits, so that no product ends in an exact half.
ELASTICITY, MARGIN_AT_ZERO, MARGIN_SLOPE = -0.3517836419057, 0.4512907316842, -0.9932175084361
LASSO_ALPHA = 2e-5

QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def rounded(df: DataFrame, default: int = 6, **digits: int) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(
        [F.round(f"`{c}`", digits.get(c, default)).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in df.columns]
    )


# ---------------------------------------------------------------- discount what-if


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return sales(spark, sf, *SALES_KEYS, "sales", "discount", "profit", "margin", *SALES_CATEGORIES)


def _study(spark: SparkSession, sf: str) -> DiscountStudy:
    return DiscountStudy.fit(_lines(spark, sf), features.split_group(SALES_KEYS, FOLDS), SALES_CATEGORIES, FOLDS)


def _given_margin():
    return scenario.constant_margin(MARGIN_SLOPE, MARGIN_AT_ZERO)


@register
def quarter_margin(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates arrive as text; sales, profit and margin by quarter."""
    lines = sales(spark, sf, "order_date", "sales", "profit")
    dated = lines.withColumn("text", F.date_format("order_date", "M/d/yyyy"))
    by_quarter = dated.groupBy(quarter_label(parse_date(F.col("text"), "M/d/yyyy")).alias("quarter")).agg(
        F.count("*").alias("n"),
        F.sum("sales").alias("total_sales"),
        F.sum("profit").alias("total_profit"),
        F.avg(ratio(F.col("profit"), F.col("sales"))).alias("mean_margin"),
        ratio(F.sum("profit"), F.sum("sales")).alias("margin"),
    )
    return rounded(by_quarter, total_sales=2, total_profit=0)


@register
def rounded_report(spark: SparkSession, sf: str) -> DataFrame:
    """Percentages by ship mode and region, rounded half to even."""
    lines = sales(spark, sf, "ship_mode", "region", "discount", "margin")
    return round_half_even(
        lines.groupBy("ship_mode", "region").agg(
            (F.avg("margin") * 100.0).alias("margin_pct"), (F.avg("discount") * 100.0).alias("discount_pct")
        ),
        2,
    )


@register
def baseline_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.baseline_totals(sales(spark, sf, "profit", "sales")), total_profit=0, total_sales=2)


@register
def discount_notes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.discount_notes(sales(spark, sf, "discount")), default=9)


@register
def extents(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.extent(sales(spark, sf, "sales", "discount", "margin"), ["sales", "discount", "margin"]))


@register
def category_levels(spark: SparkSession, sf: str) -> DataFrame:
    return summary.categories(sales(spark, sf, *SALES_CATEGORIES), SALES_CATEGORIES)


def _rounded_sweep(df: DataFrame) -> DataFrame:
    return rounded(df, **{"total_profit": 0, "total_sales": 2, "profit_change_$": 0})


@register
def discount_cap_sweep(spark: SparkSession, sf: str) -> DataFrame:
    lines = sales(spark, sf, "sales", "discount", "profit")
    return _rounded_sweep(scenario.cap_sweep(lines, scenario.cap_grid(), _given_margin(), ELASTICITY))


@register
def discount_cap_sweep_relative(spark: SparkSession, sf: str) -> DataFrame:
    lines = sales(spark, sf, "sales", "discount", "profit")
    return _rounded_sweep(scenario.cap_sweep(lines, scenario.cap_grid(), _given_margin(), ELASTICITY, mode="relative"))


@register
def sweep_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep as the result file holds it, six columns to two digits, through CSV text and back."""
    lines = sales(spark, sf, "sales", "discount", "profit")
    sweep = scenario.cap_sweep(lines, scenario.cap_grid(), _given_margin(), ELASTICITY).drop("n_null")
    report = round_half_even(sweep, 2)
    return text.parsed(text.lines(report), dict(report.dtypes))


@register
def best_cap(spark: SparkSession, sf: str) -> DataFrame:
    lines = sales(spark, sf, "sales", "discount", "profit")
    sweep = scenario.cap_sweep(lines, scenario.cap_grid(), _given_margin(), ELASTICITY)
    return rounded(scenario.best_cap(sweep), total_profit=0)


@register
def profit_curve(spark: SparkSession, sf: str) -> DataFrame:
    lines = sales(spark, sf, "sales", "discount", "profit")
    sweep = scenario.cap_sweep(lines, scenario.cap_grid(), _given_margin(), ELASTICITY)
    return rounded(scenario.profit_curve(sweep), total_profit=0, total_sales=2)


@register
def capped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The row model behind the sweep at one cap."""
    lines = sales(spark, sf, *SALES_KEYS, "sales", "discount")
    return rounded(scenario.capped_rows(lines, 0.04, _given_margin(), ELASTICITY))


@register
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = sales(spark, sf, *SALES_KEYS)
    part = features.split_group(SALES_KEYS, FOLDS)
    return lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@register
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly a fifth of the lines, rounded up, by the smallest digests of their keys; shown by parts of the key range."""
    lines = sales(spark, sf, *SALES_KEYS)
    split = features.exact_split(lines, SALES_KEYS)
    return split.groupBy("is_test", (F.col("l_orderkey") % 50).cast("int").alias("part")).agg(
        F.count("*").alias("n"), F.sum("l_partkey").alias("parts"), F.sum("l_suppkey").alias("suppliers")
    )


@register
def collinearity(spark: SparkSession, sf: str) -> DataFrame:
    """Rank and condition number of the cross-section's regressors at unit length, and the fit, by the QR route."""
    with kept(_section(spark, sf)) as section:
        found = least_squares(section, cs.LABEL, cs.FULL, scaled=True)
    return rounded(small_frame(spark, "n bigint, rank int, condition double, rss double", [(found.n, found.rank, found.condition, found.rss)]), condition=5)


@register
def many_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Margin on discount with a dummy for every part and every supplier, by conjugate gradients: the discount's coefficient."""
    lines = sales(spark, sf, "discount", "margin", "l_partkey", "l_suppkey")
    model = ols_many_levels(lines, "margin", ["discount"], ["l_partkey", "l_suppkey"])
    return rounded(small_frame(spark, "term string, estimate double, terms int", [("discount", model.coefficient("discount"), len(model.terms))]))


@register
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators learned before 2001, applied to all rows: the quarters of 2001 are unknown to them."""
    lines = sales(spark, sf, "ship_mode", "quarter", "order_date")
    levels = features.vocabulary(lines.where(F.year("order_date") < 2001), ["ship_mode", "quarter"])
    coded = features.one_hot(lines, levels)
    names = [c for c in coded.columns if c not in lines.columns]
    totals = coded.groupBy("quarter").agg(*[F.sum(f"`{c}`").alias(c) for c in names])
    return totals.unpivot("quarter", [F.col(f"`{c}`") for c in names], "indicator", "total")


@register
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled with the training rows' means and population deviations, shown for the test rows."""
    columns = ["sales", "discount", "quantity", "tax"]
    lines = sales(spark, sf, *SALES_KEYS, *columns)
    test = features.is_test(SALES_KEYS)
    return rounded(features.Scaler.fit(lines.where(~test), columns).transform(lines.where(test)))


@register
def ols_margin(spark: SparkSession, sf: str) -> DataFrame:
    table_ = _study(spark, sf).ols().coefficients(spark)
    return rounded(table_, default=7, t=4, p=5)


@register
def ols_margin_fit(spark: SparkSession, sf: str) -> DataFrame:
    stats = _study(spark, sf).ols().statistics()
    return rounded(statistics_frame(spark, {k: stats[k] for k in ("n", "df_model", "df_resid", "r2", "root_mse")}))


@register
def top_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """The 15 margin coefficients of largest magnitude."""
    model = _study(spark, sf).ols().model
    table_ = model.table(spark).where(F.col("term") != "_cons").withColumn("magnitude", F.abs("estimate"))
    return rounded(top_k(table_, "magnitude", 15, "term"), default=7)


@register
def holdout_metrics(spark: SparkSession, sf: str) -> DataFrame:
    study = _study(spark, sf)
    return rounded(study.metrics(_lines(spark, sf), study.ols().model))


@register
def elasticity(spark: SparkSession, sf: str) -> DataFrame:
    study = _study(spark, sf)
    return rounded(study.elasticity_table(_lines(spark, sf)))


@register
def whatif_profit(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep with fitted margin model and elasticity."""
    study = _study(spark, sf)
    sweep = study.sweep(_lines(spark, sf), study.ols().model)
    return rounded(sweep.drop("n_null"), 5, **{"total_profit": -1, "total_sales": -1, "profit_change_$": -1})


@register
def whatif_best(spark: SparkSession, sf: str) -> DataFrame:
    study = _study(spark, sf)
    return rounded(study.best(_lines(spark, sf), study.ols().model), total_profit=-1)


@register
def lasso_margin(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated Lasso of the margin: the chosen penalty, the variables left and the test metrics."""
    study = _study(spark, sf)
    cv = study.lasso()
    metrics = study.metrics(_lines(spark, sf), cv.model)
    chosen = {"alpha": F.lit(cv.alpha), "n_selected": F.lit(int((cv.model.coef != 0).sum())).cast("bigint")}
    return rounded(metrics.withColumns(chosen), alpha=10)


@register
def lasso_selected(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(by_magnitude(_study(spark, sf).lasso().selected(spark), "coefficient", "variable"), default=7)


@register
def lasso_path(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared error over the folds for each of the 100 penalties, and which is chosen."""
    cv = _study(spark, sf).lasso()
    return rounded(cv.path(spark).withColumn("is_best", F.col("alpha") == F.lit(cv.alpha)), default=10)


@register
def lasso_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """For each fold left out and each penalty, how far the path's solution is from an optimum, counted from the rows."""
    study = _study(spark, sf)
    lines = _lines(spark, sf).withColumn("part", study.part).where(F.col("part") >= 0)
    return rounded(study.lasso().certificate(lines, "margin", "part"), alpha=10, objective=9)


@register
def whatif_lasso(spark: SparkSession, sf: str) -> DataFrame:
    study = _study(spark, sf)
    sweep = study.sweep(_lines(spark, sf), study.lasso().model)
    return rounded(sweep.drop("n_null"), 5, **{"total_profit": -1, "total_sales": -1, "profit_change_$": -1})


@register
def lasso_one_feature(spark: SparkSession, sf: str) -> DataFrame:
    grams = gram_table(sales(spark, sf, "discount", "margin"), ["discount", "margin"])
    model = lasso(grams.moments(), "margin", [Term("discount")], 2e-4)
    return rounded(model.table(spark), default=8)


@register
def lasso_all_features(spark: SparkSession, sf: str) -> DataFrame:
    """Discount and all dummies at one penalty, on the training rows."""
    study = _study(spark, sf)
    model = lasso(study.grams.moments(study.folds), "margin", study.terms, LASSO_ALPHA)
    return rounded(model.table(spark), default=8)


@register
def lasso_nonzero(spark: SparkSession, sf: str) -> DataFrame:
    """The variables that the penalty leaves, by the size of their coefficients."""
    coefficients = lasso_all_features(spark, sf)
    return by_magnitude(coefficients.where((F.col("estimate") != 0) & (F.col("term") != "_cons")), "estimate", "term")


@register
def lasso_three_features(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised regressors, one of which the penalty removes."""
    columns = ["discount", "quantity", "tax"]
    moments = gram_table(sales(spark, sf, *columns, "margin"), [*columns, "margin"]).moments()
    terms = [Term(c) for c in columns]
    scale = (moments.at(terms)[1].diagonal() / moments.n) ** 0.5
    return rounded(lasso(moments, "margin", terms, 1e-3, scale).table(spark), default=8)


@register
def lasso_cv_one_feature(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared error over the folds for each penalty, with the one that is chosen."""
    lines = sales(spark, sf, *SALES_KEYS, "discount", "margin")
    grams = gram_table(lines, ["discount", "margin"], group=features.split_group(SALES_KEYS, FOLDS))
    cv = lasso_cv(grams, "margin", [Term("discount")], range(FOLDS))
    path = cv.path(spark).withColumn("is_best", F.col("alpha") == F.lit(cv.alpha))
    return rounded(path, default=10)


@register
def lasso_cv_three_features(spark: SparkSession, sf: str) -> DataFrame:
    """The same with standardised regressors; the coefficients of the refit stand next to the chosen penalty."""
    columns = ["discount", "quantity", "tax"]
    lines = sales(spark, sf, *SALES_KEYS, *columns, "margin")
    grams = gram_table(lines, [*columns, "margin"], group=features.split_group(SALES_KEYS, FOLDS))
    cv = lasso_cv(grams, "margin", [Term(c) for c in columns], range(FOLDS), standardize=True)
    best = F.col("alpha") == F.lit(cv.alpha)
    refit = {f"b_{c}": F.when(best, F.lit(cv.model.coefficient(c))) for c in columns}
    return rounded(cv.path(spark).withColumn("is_best", best).withColumns(refit), default=9)


@register
def durbin_watson(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals of margin on discount and quantity, in the order of the line keys."""
    lines = sales(spark, sf, *SALES_KEYS, "discount", "quantity", "margin")
    fit = ols(lines, "margin", ["discount", "quantity"])
    rows = with_residuals(lines, fit)
    return rounded(order.durbin_watson(rows, "residual", SALES_KEYS, rows=int(fit.n), rows_per_range=SMALL_RANGE))


@register
def actual_predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Actual against predicted margin as cell counts, with the extents of both axes."""
    lines = sales(spark, sf, "discount", "quantity", "margin")
    fit = ols(lines, "margin", ["discount", "quantity"])
    return rounded(diagnose.binned_pairs(with_residuals(lines, fit), "margin", "fitted", 40))


# ---------------------------------------------------------------- panel


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return pl.build_panel(macro_table(spark, sf), score_table(spark, sf), *PANEL_YEARS)


@register
def panel_macro(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pl.prepare_macro(macro_table(spark, sf), 1996, 2000), gdp_usd=2)


@register
def panel_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pl.prepare_score(score_table(spark, sf), "score", 1996, 2000))


@register
def score_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """An exported sheet as CSV text, read by position: year, country and score, whatever the header says."""
    sheet = text.parsed(text.lines(score_table(spark, sf)), pl.by_position(["c0", "c1", "c2"]))
    return rounded(pl.prepare_score(sheet, "score", 1996, 2000))


@register
def panel_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pl.in_country_order(_panel(spark, sf)), gdp_usd=2)


@register
def panel_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as lines of CSV and parsed again, without a file."""
    panel = pl.in_country_order(_panel(spark, sf))
    return rounded(text.parsed(text.lines(panel), dict(panel.dtypes)), gdp_usd=2)


def _panel_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.when(F.col("unemployment_rate") <= 0.4, F.col("unemployment_rate"))
    return _panel(spark, sf).withColumn("unemployment_rate", gap)


@register
def panel_complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Model columns and label of the rows without a gap."""
    panel = _panel_with_gaps(spark, sf)
    return rounded(pl.model_rows(panel).select("score", *pl.model_columns(panel)), gdp_usd=2)


@register
def panel_missing(spark: SparkSession, sf: str) -> DataFrame:
    panel = _panel_with_gaps(spark, sf)
    return missing_report(panel, ["score", *pl.model_columns(panel)])


@register
def ols_origin(spark: SparkSession, sf: str) -> DataFrame:
    fit = pl.one_year_ols(_panel(spark, sf), ONE_YEAR)
    scaled = fit.coefficients(spark)
    # one regressor is a total of about 1e7: its coefficient is shown per 1e9
    unit = F.when(F.col("term") == "gdp_usd", 1e9).otherwise(1.0)
    return rounded(scaled.withColumns({c: F.col(c) * unit for c in ("estimate", "se", "low", "high")}), t=4, p=5)


@register
def ols_origin_fit(spark: SparkSession, sf: str) -> DataFrame:
    stats = pl.one_year_ols(_panel(spark, sf), ONE_YEAR).statistics()
    names = ("n", "df_model", "df_resid", "r2", "r2_adj", "f", "f_p", "loglik", "aic", "bic")
    return rounded(statistics_frame(spark, {k: stats[k] for k in names}), default=5)


@register
def ols_origin_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Everything the printed summary holds: statistics, residual tests and Durbin–Watson in country order."""
    with kept(_panel(spark, sf).where(F.col("Year") == ONE_YEAR)) as panel:
        fit = pl.one_year_ols(panel, ONE_YEAR)
        rows = with_residuals(panel, fit)
        shape = diagnose.residual_shape(rows)
        watson = order.durbin_watson(rows, "residual", ["Country"], rows=int(fit.n)).first()[0]
    return statistics_frame(spark, {**fit.statistics(), **shape, "durbin_watson": watson})


@register
def durbin_watson_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals of the one-year regression in country order."""
    panel = _panel(spark, sf).where(F.col("Year") == ONE_YEAR)
    fit = pl.one_year_ols(panel, ONE_YEAR)
    return rounded(order.durbin_watson(with_residuals(panel, fit), "residual", ["Country"], rows=int(fit.n)))


def _panel_lasso(spark: SparkSession, sf: str):
    panel = _panel(spark, sf)
    parts = pl.split_panel(panel, PANEL_FOLDS)
    return pl.panel_lasso(parts, pl.model_columns(panel), PANEL_FOLDS), parts.where(F.col("part") < 0)


@register
def panel_lasso(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(by_magnitude(_panel_lasso(spark, sf)[0].selected(spark), "coefficient", "variable"))


@register
def panel_lasso_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """The certificate of ``lasso_certificate`` for the panel, whose regressors are standardised."""
    panel = _panel(spark, sf)
    parts = pl.split_panel(panel, PANEL_FOLDS).where(F.col("part") >= 0)
    cv = pl.panel_lasso(parts, pl.model_columns(panel), PANEL_FOLDS)
    return rounded(cv.certificate(parts, "score", "part"), alpha=9, objective=8)


@register
def panel_lasso_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen penalty, the variables left and the error on the test rows."""
    cv, test = _panel_lasso(spark, sf)
    chosen = {"alpha": F.lit(cv.alpha), "n_selected": F.lit(int((cv.model.coef != 0).sum())).cast("bigint")}
    return rounded(metrics_of(test, "score", cv.model.predict()).withColumns(chosen), alpha=9)


@register
def panel_lasso_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Actual against predicted scores of the test rows as cell counts."""
    cv, test = _panel_lasso(spark, sf)
    with kept(test) as rows:
        pairs = rows.select(F.col("score").alias("actual"), cv.model.predict().alias("predicted"))
        return rounded(diagnose.binned_pairs(pairs, "actual", "predicted", 20))


_forests: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _forest(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The published grid, fitted once for a session and folder: three small tables that several queries show."""
    key = spark.sparkContext.applicationId, sf
    if key not in _forests:
        panel = _panel(spark, sf)
        columns = pl.model_columns(panel)
        with kept(pl.split_panel(panel, PANEL_FOLDS)) as parts:
            model = pl.panel_forest(parts, columns, PANEL_FOLDS, trees=FULL_TREES, parallelism=8)
            test = model.predict(pl.scaled_split(parts, columns).where(F.col("part") < 0))
            with kept(test.select(F.col("score").alias("actual"), F.col("prediction").alias("predicted"))) as pairs:
                error = pairs.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)).alias("mse")).first()
                cells = diagnose.binned_pairs(pairs, "actual", "predicted", 20)
                _forests[key] = {
                    "grid": model.grid_table(spark),
                    "importance": top_k(model.importances(spark), "importance", 15, "feature"),
                    "holdout": small_frame(spark, "n bigint, mse double", [(error["n"], error["mse"])]),
                    "pairs": small_frame(spark, cells.schema.simpleString()[7:-1].replace(":", " "), [tuple(r) for r in cells.collect()]),
                }
    return _forests[key]


@register
def forest_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Error over ten folds of 100, 500 and 1000 trees with both feature settings."""
    return _forest(spark, sf)["grid"]


@register
def forest_importance(spark: SparkSession, sf: str) -> DataFrame:
    return _forest(spark, sf)["importance"]


@register
def forest_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return _forest(spark, sf)["holdout"]


@register
def forest_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Actual against predicted scores of the test rows as cell counts."""
    return _forest(spark, sf)["pairs"]


@register
def forest_study(spark: SparkSession, sf: str) -> DataFrame:
    """The whole published study in one table: grid, importances and hold-out error."""
    found = _forest(spark, sf)
    name = F.concat_ws(" ", F.col("trees").cast("string"), "features")
    grid = found["grid"].select(F.lit("grid").alias("table"), name.alias("name"), F.col("cv_mse").alias("value"))
    weights = found["importance"].select(F.lit("importance"), "feature", "importance")
    test = found["holdout"].select(F.lit("holdout"), F.lit("mse"), "mse")
    return grid.union(weights).union(test)


@register
def forest_out_of_bag(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-bag error of 100 trees on the training rows."""
    panel = _panel(spark, sf)
    columns = pl.model_columns(panel)
    rows = pl.split_panel(panel, PANEL_FOLDS).where(F.col("part") >= 0)
    return oob_error(out_of_bag(rows, "score", columns, ["Country", "Year"], trees=FULL_TREES[0]), "score")


# ---------------------------------------------------------------- cross-section


def _section(spark: SparkSession, sf: str) -> DataFrame:
    return cs.derive(cross_section(spark, sf))


@register
def summarize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summary.summarize(cross_section(spark, sf), cs.SUMMARY))


@register
def derived_variables(spark: SparkSession, sf: str) -> DataFrame:
    """Shown in single precision: means of prices often end in an exact half decimal, never in a half bit."""
    names = [cs.LABEL, "gdppc_thousands", "interraction_gdppc_trade"]
    return _section(spark, sf).select("unit", *[F.col(c).cast("float").cast("double").alias(c) for c in names])


def _coefficients(spark: SparkSession, model: cs.CrossSectionModel) -> DataFrame:
    return rounded(model.fit.coefficients(spark), default=8, t=4, p=5)


def _fit_table(spark: SparkSession, model: cs.CrossSectionModel) -> DataFrame:
    stats = model.fit.statistics()
    names = (
        "n", "df_model", "df_resid", "ss_model", "ss_resid", "ss_total", "ms_model", "ms_resid", "f", "r2", "r2_adj",
        "root_mse", "f_p",
    )
    return rounded(statistics_frame(spark, {k: stats[k] for k in names}))


@register
def ols_full(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(spark, cs.CrossSectionModel.estimate(_section(spark, sf)))


@register
def ols_reduced(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(spark, cs.CrossSectionModel.estimate(_section(spark, sf), cs.REDUCED))


@register
def ols_full_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_table(spark, cs.CrossSectionModel.estimate(_section(spark, sf)))


@register
def ols_reduced_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_table(spark, cs.CrossSectionModel.estimate(_section(spark, sf), cs.REDUCED))


@register
def vif_full(spark: SparkSession, sf: str) -> DataFrame:
    section = _section(spark, sf)
    return rounded(cs.CrossSectionModel.estimate(section).vif(section))


@register
def vif_reduced(spark: SparkSession, sf: str) -> DataFrame:
    section = _section(spark, sf)
    return rounded(cs.CrossSectionModel.estimate(section, cs.REDUCED).vif(section))


@register
def mean_vif_by_model(spark: SparkSession, sf: str) -> DataFrame:
    section = _section(spark, sf)
    moments = gram_table(section, [*dict.fromkeys([*cs.FULL, *cs.REDUCED]), cs.LABEL]).moments()
    rows = [
        mean_vif(vif(spark, moments, [Term(c) for c in names])).withColumn("model", F.lit(model))
        for model, names in (("full", cs.FULL), ("reduced", cs.REDUCED))
    ]
    return rounded(rows[0].unionByName(rows[1]))


@register
def residuals(spark: SparkSession, sf: str) -> DataFrame:
    section = _section(spark, sf)
    fit = cs.CrossSectionModel.estimate(section).fit
    return rounded(with_residuals(section, fit).select("unit", "fitted", "residual"))


@register
def residual_scatter(spark: SparkSession, sf: str) -> DataFrame:
    # The tables are joined once; only the cells, 400 at most, leave the block.
    with kept(_section(spark, sf)) as section:
        fit = cs.CrossSectionModel.estimate(section).fit
        cells = rounded(diagnose.binned_pairs(with_residuals(section, fit), "fitted", "residual", 20))
        return spark.createDataFrame(cells.toArrow())


@register
def residual_shape(spark: SparkSession, sf: str) -> DataFrame:
    with kept(_section(spark, sf)) as section:
        return rounded(statistics_frame(spark, diagnose.residual_shape(_residuals(section))), default=5)


def _residuals(section: DataFrame) -> DataFrame:
    return with_residuals(section, cs.CrossSectionModel.estimate(section).fit).select("residual")


@register
def residual_density(spark: SparkSession, sf: str) -> DataFrame:
    with kept(_section(spark, sf)) as section:
        return rounded(diagnose.density(_residuals(section)))


@register
def shapiro_wilk(spark: SparkSession, sf: str) -> DataFrame:
    with kept(_section(spark, sf)) as section:
        return rounded(diagnose.shapiro_wilk(_residuals(section)), v=5, z=5, p=5)


@register
def shapiro_francia(spark: SparkSession, sf: str) -> DataFrame:
    """On a column with many equal values, at any size; z and p only where they are calibrated."""
    found = diagnose.shapiro_francia(sales(spark, sf, "quantity"), "quantity", rows_per_bin=SMALL_RANGE)
    return rounded(found, default=7)


@register
def im_test(spark: SparkSession, sf: str) -> DataFrame:
    with kept(_section(spark, sf)) as section:
        model = cs.CrossSectionModel.estimate(section)
        return rounded(diagnose.im_test(section, model.fit, model.moments), default=4, p=5)
