import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gramwise.operators import gram as gram_module
from gramwise.operators.gram import Term, gram_table
from gramwise.operators.lasso import lasso, lasso_cv, lasso_path
from gramwise.operators.ols import fit_moments, holdout_metrics, ols, vif, with_residuals


def _frame(n=400, seed=0):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "x": rng.normal(1000.0, 1.0, n),
            "z": rng.uniform(0, 3, n),
            "g": rng.choice(["a", "b", "c", "d"], n),
            "h": rng.choice(["u", "v"], n),
            "fold": rng.integers(-1, 4, n),
        }
    )
    frame["y"] = 2 * (frame.x - 1000) - frame.z + (frame.g == "c") * 0.7 + (frame.h == "v") * 0.2 + rng.normal(0, 0.3, n)
    return frame


def _design(frame, levels=("b", "c", "d")):
    columns = [frame.x, frame.z] + [(frame.g == v).astype(float) for v in levels] + [(frame.h == "v").astype(float)]
    return np.column_stack(columns)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_ols_matches_least_squares(spark, partitions):
    frame = _frame()
    fit = ols(spark.createDataFrame(frame).repartition(partitions), "y", ["x", "z"], ["g", "h"])
    design = np.column_stack([np.ones(len(frame)), _design(frame)])
    expected, *_ = np.linalg.lstsq(design, frame.y, rcond=None)
    assert [t.name for t in fit.model.terms] == ["x", "z", "g_b", "g_c", "g_d", "h_v"]
    np.testing.assert_allclose([fit.model.intercept, *fit.model.coef], expected, rtol=1e-8, atol=1e-9)
    residual = frame.y - design @ expected
    assert fit.rss == pytest.approx(residual @ residual, rel=1e-9)
    s2 = residual @ residual / (len(frame) - 7)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * s2)
    got = [r["se"] for r in fit.coefficients(spark).collect()]
    np.testing.assert_allclose(got, se, rtol=1e-5)


def test_residuals_are_orthogonal_to_the_regressors(spark):
    df = spark.createDataFrame(_frame())
    fit = ols(df, "y", ["x", "z"], ["g"])
    rows = with_residuals(df, fit)
    sums = rows.agg(
        F.sum("residual"), F.sum(F.col("residual") * (F.col("x") - 1000)), F.sum(F.col("residual") * F.col("z")),
        F.sum(F.when(F.col("g") == "c", F.col("residual"))),
    ).first()
    np.testing.assert_allclose(list(sums), 0.0, atol=1e-7)


def test_origin_model_and_uncentred_r2(spark):
    frame = _frame()
    fit = ols(spark.createDataFrame(frame), "y", ["x", "z"], fit_intercept=False)
    design = frame[["x", "z"]].to_numpy()
    expected, *_ = np.linalg.lstsq(design, frame.y, rcond=None)
    np.testing.assert_allclose(fit.model.coef, expected, rtol=1e-8)
    residual = frame.y - design @ expected
    assert fit.r2 == pytest.approx(1 - residual @ residual / (frame.y @ frame.y), rel=1e-9)
    assert fit.df_resid == len(frame) - 2
    assert fit.condition == pytest.approx(np.linalg.cond(design), rel=1e-6)


def test_missing_values_leave_the_fit_and_null_the_residual(spark):
    frame = _frame()
    whole = spark.createDataFrame(frame.drop(columns=["fold"]))
    gaps = spark.createDataFrame([(None, 1.0, "a", "u", 2.0), (1.0, 1.0, "a", "u", None)], whole.schema)
    df = whole.unionByName(gaps)
    fit, without = ols(df, "y", ["x", "z"], ["g"]), ols(whole, "y", ["x", "z"], ["g"])
    np.testing.assert_allclose(fit.model.coef, without.model.coef, rtol=1e-10)
    assert fit.n == len(frame)
    assert with_residuals(df, fit).where("residual is null").count() == 2


def test_missing_category_is_a_category_of_its_own(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 1.2), ("b", 2.0), ("b", 2.2), (None, 5.0), (None, 5.4)], "g string, y double"
    )
    fit = ols(df, "y", [], ["g"])
    assert [t.name for t in fit.model.terms] == ["g_b", "g_nan"]
    np.testing.assert_allclose(fit.model.coef, [1.0, 4.1])
    assert df.where("g is null").select(fit.model.predict()).first()[0] == pytest.approx(5.2)


def test_unknown_category_predicts_the_base_level(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("a", 1.0)], "g string, y double")
    model = ols(df, "y", [], ["g"]).model
    got = spark.createDataFrame([("new",), ("b",)], "g string").select(model.predict()).collect()
    assert [r[0] for r in got] == pytest.approx([1.0, 2.0])


def test_collinear_terms_get_the_smallest_solution(spark):
    frame = _frame()
    frame["twice"] = 2 * frame.z
    frame["constant"] = 3.0
    df = spark.createDataFrame(frame)
    fit = ols(df, "y", ["z", "twice", "constant"])
    centred = frame[["z", "twice", "constant"]] - frame[["z", "twice", "constant"]].mean()
    expected = np.linalg.pinv(centred.to_numpy()) @ (frame.y - frame.y.mean())
    np.testing.assert_allclose(fit.model.coef, expected, atol=1e-9)
    assert fit.rank == 1
    assert {r["se"] for r in fit.coefficients(spark).collect()} == {None}
    moments = gram_table(df, ["z", "twice"]).moments()
    assert {r["vif"] for r in vif(spark, moments, moments.terms).collect()} == {None}


def test_as_many_rows_as_terms(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 5.0), (4.0, 4.0, 4.0)], "a double, b double, y double")
    fit = ols(df, "y", ["a", "b"])
    assert fit.rss == pytest.approx(0.0, abs=1e-10) and fit.df_resid == 0
    assert {r["p"] for r in fit.coefficients(spark).collect()} == {None}


def test_no_rows_is_an_error(spark):
    empty = spark.createDataFrame([], "x double, g string, y double")
    for categorical in ([], ["g"]):
        with pytest.raises(ValueError, match="no complete rows|no rows"):
            ols(empty, "y", ["x"], categorical)


def test_wide_products_equal_the_aggregates(spark, monkeypatch):
    df = spark.createDataFrame(_frame())
    narrow = gram_table(df, ["x", "z", "y"], group=F.col("fold"))
    monkeypatch.setattr(gram_module, "WIDE", 2)
    wide = gram_table(df.repartition(5), ["x", "z", "y"], group=F.col("fold"))
    assert set(narrow.groups) == set(wide.groups) == {-1, 0, 1, 2, 3}
    for groups in ([0], [1, 2], None):
        a, b = narrow.moments(groups), wide.moments(groups)
        np.testing.assert_allclose(a.scatter, b.scatter, rtol=1e-8)
        np.testing.assert_allclose(a.mean, b.mean, rtol=1e-10)


def test_too_many_terms_is_refused(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("g"), F.col("id").cast("double").alias("y"))
    with pytest.raises(ValueError, match="too many"):
        gram_table(df, ["y"], ["g"], most=1000)
    assert len(gram_table(df, ["y"], ["g"]).terms) == 201


def test_groups_keep_training_categories_apart(spark):
    df = spark.createDataFrame(
        [("a", 0, 1.0), ("b", 0, 2.0), ("c", -1, 9.0), ("b", 1, 2.0), ("a", 1, 1.0)], "g string, f int, y double"
    )
    grams = gram_table(df, ["y"], ["g"], F.col("f"))
    assert [t.value for t in grams.dummies(["g"], [0, 1])] == ["b"]
    assert grams.levels("g") == ["a", "b", "c"]


def test_holdout_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y double, p double")
    row = holdout_metrics(df, "y", F.col("p")).first()
    assert row["n"] == 3 and row["mae"] == pytest.approx(0.5) and row["mse"] == pytest.approx(1.25 / 3)
    assert row["r2"] == pytest.approx(1 - 1.25 / np.sum((np.array([1, 2, 4]) - 7 / 3) ** 2))


def test_lasso_matches_mllib(spark):
    frame = _frame()
    df = spark.createDataFrame(frame)
    grams = gram_table(df, ["x", "z", "y"], ["g", "h"])
    terms = [Term("x"), Term("z"), *grams.dummies(["g", "h"])]
    model = lasso(grams.moments(), "y", terms, 0.05)
    indicators = df.select(
        "y", "x", "z", *[(F.col(t.column) == t.value).cast("double").alias(t.name) for t in terms if t.value]
    )
    vectors = VectorAssembler(inputCols=[t.name for t in terms], outputCol="features").transform(indicators)
    other = LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=0.05, standardization=False, tol=1e-12, maxIter=2000)
    fitted = other.fit(vectors)
    np.testing.assert_allclose(model.coef, fitted.coefficients.toArray(), atol=1e-4)
    assert model.intercept == pytest.approx(fitted.intercept, abs=0.1)


def test_lasso_optimality(spark):
    frame = _frame()
    grams = gram_table(spark.createDataFrame(frame), ["x", "z", "y"], ["g", "h"])
    terms = [Term("x"), Term("z"), *grams.dummies(["g", "h"])]
    design = _design(frame)
    for alpha in (0.3, 0.03, 0.003):
        model = lasso(grams.moments(), "y", terms, alpha)
        residual = frame.y - model.intercept - design @ model.coef
        gradient = design.T @ (residual - residual.mean()) / len(frame)
        active = model.coef != 0
        assert np.all(np.abs(gradient) <= alpha + 1e-8)
        np.testing.assert_allclose(gradient[active], alpha * np.sign(model.coef[active]), atol=1e-8)


@pytest.mark.parametrize("kind", ["independent", "correlated", "duplicate", "indicators"])
def test_lasso_path_is_optimal(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 12))
    if kind == "correlated":
        x = x @ rng.normal(size=(12, 12))
    if kind == "duplicate":
        x[:, 3], x[:, 9] = x[:, 7], x[:, 1] + x[:, 2]
    if kind == "indicators":
        x = (x > 0.5).astype(float)
        x[:, 1], x[:, 5] = 1 - x[:, 0], 0.0
    y = x[:, :3].sum(axis=1) + rng.normal(size=200)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    q, c = xc.T @ xc / 200, xc.T @ yc / 200
    alphas = np.abs(c).max() * np.logspace(0, -3, 60)
    for alpha, w in zip(alphas, lasso_path(q, c, alphas), strict=True):
        gradient = c - q @ w
        assert np.all(np.abs(gradient) <= alpha * (1 + 1e-6))
        active = w != 0
        np.testing.assert_allclose(gradient[active], alpha * np.sign(w[active]), rtol=1e-6)


@pytest.mark.parametrize("standardize", [False, True])
def test_lasso_cv_against_row_wise_fits(spark, standardize):
    frame = _frame(n=300)
    frame["x"] -= 1000
    grams = gram_table(spark.createDataFrame(frame).repartition(7), ["x", "z", "y"], ["g", "h"], F.col("fold"))
    terms = [Term("x"), Term("z"), *grams.dummies(["g", "h"], range(4))]
    cv = lasso_cv(grams, "y", terms, range(4), n_alphas=20, standardize=standardize)

    train = frame[frame.fold >= 0]
    design, label = _design(train), train.y.to_numpy()
    if standardize:
        design = (design - design.mean(axis=0)) / design.std(axis=0)
    centred = design - design.mean(axis=0)
    top = np.abs(centred.T @ (label - label.mean())).max() / len(label)
    np.testing.assert_allclose(cv.alphas, top * np.logspace(0, -3, 20), rtol=1e-9)
    mse = np.empty((20, 4))
    for f in range(4):
        keep = (train.fold != f).to_numpy()
        a, b = design[keep], label[keep]
        for i, alpha in enumerate(cv.alphas):
            w = np.zeros(design.shape[1])
            ac, bc = a - a.mean(axis=0), b - b.mean()
            for _ in range(500):
                for j in range(len(w)):
                    z = ac[:, j] @ (bc - ac @ w + ac[:, j] * w[j]) / len(b)
                    w[j] = np.sign(z) * max(abs(z) - alpha, 0) / (ac[:, j] @ ac[:, j] / len(b))
            prediction = b.mean() + (design[~keep] - a.mean(axis=0)) @ w
            mse[i, f] = np.mean((label[~keep] - prediction) ** 2)
    np.testing.assert_allclose(cv.mse, mse, rtol=1e-6)
    assert cv.alpha == pytest.approx(cv.alphas[mse.mean(axis=1).argmin()])
    table = cv.selected(spark).collect()
    assert [abs(r["coefficient"]) for r in table] == sorted((abs(r["coefficient"]) for r in table), reverse=True)
    assert len(table) == np.count_nonzero(cv.model.coef)


def test_moment_selection_fits_two_labels_from_one_pass(spark):
    frame = _frame()
    frame["w"] = frame.z * 3 + 1
    grams = gram_table(spark.createDataFrame(frame), ["z", "y", "w"], ["g"])
    first = fit_moments(grams.moments(), "y", [Term("z"), *grams.dummies(["g"])])
    second = fit_moments(grams.moments(), "w", [Term("z")])
    assert first.model.coefficient("z") == pytest.approx(-1, abs=0.5)
    assert second.model.coefficient("z") == pytest.approx(3) and second.model.intercept == pytest.approx(1)
