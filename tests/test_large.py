"""Solvers for many categories, the QR route, exact splits and the Lasso certificate."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramwise.operators import features
from gramwise.operators.gram import Term, gram_table, pair_sums
from gramwise.operators.iterative import lasso_many_levels, level_system, ols_many_levels
from gramwise.operators.lasso import lasso, lasso_cv
from gramwise.operators.ols import ols
from gramwise.operators.qr import least_squares, r_factor


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    frame = pd.DataFrame({"x": 1e6 + rng.normal(size=n), "z": rng.normal(size=n)})
    frame["a"] = rng.integers(0, 40, n).astype(str)
    frame["b"] = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 9, n).astype(str))
    frame["c"] = rng.choice(["u", "v", None], n)
    frame["y"] = 0.5 * frame.x + frame.z + frame.a.astype(int) / 10 + (frame.b == "hot") + rng.normal(0, 0.3, n)
    frame["fold"] = rng.integers(0, 4, n)
    return spark.createDataFrame(frame).repartition(5).cache()


def _by_name(model):
    return {t.name: b for t, b in zip(model.terms, model.coef, strict=True)} | {"_cons": model.intercept}


def test_gram_of_pairs_equals_indicators(mixed):
    grams = gram_table(mixed, ["x", "z", "y"], ["a", "b", "c"], F.col("fold"))
    rows = mixed.toPandas()
    for fold in range(4):
        part = rows[rows.fold == fold]
        columns = [part[t.column] if t.value is None else part[t.column].isna() if t.name.endswith("_nan") else part[t.column] == t.value for t in grams.terms]
        x = np.column_stack(columns).astype(float)
        moments = grams.moments([fold])
        np.testing.assert_allclose(moments.mean, x.mean(0))
        np.testing.assert_allclose(moments.scatter, (x - x.mean(0)).T @ (x - x.mean(0)), atol=1e-6)


def test_tasks_send_pairs_and_not_combinations(mixed):
    levels = [mixed.select(c).distinct().count() for c in "abc"]
    rows = mixed.select(F.lit(0).alias("__group"), *[F.coalesce(F.col(c), F.lit("-")).alias(c) for c in "abc"], "y").coalesce(1)
    bound = 1 + sum(levels) + sum(levels[i] * levels[j] for i in range(3) for j in range(i))
    assert pair_sums(rows, ["y"], ["a", "b", "c"]).count() <= bound


def test_pair_sums_start_anew_beyond_their_bound(mixed, monkeypatch):
    from gramwise.operators import gram

    whole = gram_table(mixed, ["z", "y"], ["a", "b"])
    monkeypatch.setattr(gram, "_MOST_SUMS", 50)
    parts = gram_table(mixed, ["z", "y"], ["a", "b"])
    np.testing.assert_allclose(parts.moments().scatter, whole.moments().scatter, atol=1e-8)


def test_many_levels_equal_the_dense_solution(mixed):
    dense = _by_name(ols(mixed, "y", ["x", "z"], ["a", "b", "c"]).model)
    found = _by_name(ols_many_levels(mixed, "y", ["x", "z"], ["a", "b", "c"]))
    assert found.keys() == dense.keys()
    for name in dense:
        assert found[name] == pytest.approx(dense[name], rel=1e-7, abs=1e-7), name


def test_many_levels_lasso_equals_the_dense_solution(mixed):
    grams = gram_table(mixed, ["x", "z", "y"], ["a", "b", "c"])
    terms = [Term("x"), Term("z"), *grams.dummies(["a", "b", "c"])]
    dense = _by_name(lasso(grams.moments(), "y", terms, 0.01))
    found = _by_name(lasso_many_levels(mixed, "y", ["x", "z"], ["a", "b", "c"], 0.01))
    assert sum(v == 0 for v in found.values()) == sum(v == 0 for v in dense.values()) > 0
    for name in dense:
        assert found[name] == pytest.approx(dense[name], rel=1e-6, abs=1e-6), name


def test_more_levels_than_a_matrix_holds(spark):
    """50,000 levels: 2.5 billion products as a matrix, two vectors and a table of cells here."""
    df = spark.range(200_000).select(
        (F.col("id") % 50_000).cast("string").alias("g"), (F.hash("id") % 7).cast("string").alias("h"), (F.xxhash64("id") % 1000 / 1000.0).alias("x")
    )
    effect = (F.xxhash64("g") % 100) / 100.0
    df = df.withColumn("y", 2.0 * F.col("x") + effect + F.when(F.col("h") == "3", 5.0).otherwise(0.0))
    with pytest.raises(ValueError, match="too many"):
        gram_table(df, ["x", "y"], ["g", "h"])
    model = ols_many_levels(df, "y", ["x"], ["g", "h"], tolerance=1e-10)
    assert model.coefficient("x") == pytest.approx(2.0, abs=1e-6)
    assert model.coefficient("h_3") - model.coefficient("h_4") == pytest.approx(5.0, abs=1e-6)
    assert len(model.terms) > 50_000


def test_system_without_categories(mixed):
    with level_system(mixed, "y", ["z"], []) as system:
        assert len(system.levels) == 0
    assert ols_many_levels(mixed, "y", ["z"], []).coefficient("z") == pytest.approx(ols(mixed, "y", ["z"]).model.coefficient("z"))


@pytest.mark.parametrize("condition", [1e4, 1e10])
def test_condition_number_keeps_its_digits(spark, condition):
    rng = np.random.default_rng(5)
    u = np.linalg.qr(rng.normal(size=(900, 4)))[0]
    v = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    x = u * np.array([1.0, 0.1, 1e-2, 1.0 / condition]) @ v.T
    w = np.array([1.0, -2.0, 0.5, 3.0])
    frame = pd.DataFrame(x, columns=list("abcd"))
    frame["y"] = x @ w
    df = spark.createDataFrame(frame).repartition(7)
    found = least_squares(df, "y", list("abcd"), intercept=False)
    assert found.condition == pytest.approx(condition, rel=1e-5)
    assert found.rank == 4 and found.n == 900
    np.testing.assert_allclose(found.coef, w, rtol=1e-12 * condition, atol=1e-12 * condition)


def test_rank_and_smallest_norm(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame(rng.normal(size=(50, 2)), columns=["a", "b"])
    frame["c"] = frame.a + frame.b
    frame["y"] = frame.c * 3 + 1
    frame.loc[7, "a"] = np.nan
    df = spark.createDataFrame(frame).withColumn("a", F.nanvl("a", F.lit(None)))
    found = least_squares(df, "y", ["a", "b", "c"])
    assert found.rank == 3 and found.n == 49 and found.rss < 1e-18
    rows = frame.dropna()
    x = np.column_stack([np.ones(49), rows[["a", "b", "c"]]])
    np.testing.assert_allclose(found.coef, np.linalg.lstsq(x, rows.y, rcond=None)[0], atol=1e-9)
    few = least_squares(df.limit(2), "y", ["a", "b"])
    assert few.rank == 2 and few.n <= 2


def test_a_task_sends_one_factor(spark, mixed):
    n, factor = r_factor(mixed, ["z", "y"], intercept=True)
    rows = mixed.select("z", "y").toPandas().to_numpy()
    x = np.column_stack([np.ones(len(rows)), rows])
    assert n == 3000
    np.testing.assert_allclose(factor.T @ factor, x.T @ x, rtol=1e-10)


@pytest.mark.parametrize("n", [1, 5, 7, 1000, 1234])
def test_exact_split(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 3).alias("other"))
    split = features.exact_split(df, ["id"])
    assert split.where("is_test").count() == -(-n // 5)
    again = features.exact_split(df.repartition(3), ["id"])
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))


def test_exact_split_of_equal_keys(spark):
    """A third of all rows have one key, others none at all."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), "id").repartition(4)
    for percent in (20, 50, 100):
        assert features.exact_split(df, ["k"], percent).where("is_test").count() == 30 * percent
    same = spark.range(700).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("v"))
    split = features.exact_split(same, ["k"])
    assert split.count() == 700 and split.where("is_test").count() == 140
    assert split.groupBy("v").count().where("count = 350").count() == 2
    assert features.exact_split(df.limit(0), ["k"]).count() == 0


def test_certificate_accepts_the_path_and_rejects_others(mixed):
    grams = gram_table(mixed, ["x", "z", "y"], ["a", "b"], F.col("fold"))
    terms = [Term("z"), *grams.dummies(["a", "b"]), Term("x")]
    cv = lasso_cv(grams, "y", terms, range(4), n_alphas=12, standardize=True)
    rows = cv.certificate(mixed, "y", "fold").collect()
    assert len(rows) == 5 * 12 and max(r["gap"] for r in rows) < 1e-6
    assert {r["n"] for r in rows if r["fold"] == -1} == {3000}
    cv.solutions[2][1][5, 0] *= 1.01
    bad = [r["fold"] for r in cv.certificate(mixed, "y", "fold").collect() if r["gap"] > 1e-3]
    assert bad == [2]


def test_pairs_are_summed_for_as_many_cells_as_there_are_levels(spark):
    """Batches far smaller than the vector, summed together."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        df = spark.range(400).select(F.col("id").cast("string").alias("g"), (F.col("id") % 7).cast("string").alias("h"), F.rand(1).alias("x"), F.rand(2).alias("y"))
        with level_system(df, "y", ["x"], ["g", "h"]) as system:
            v = np.arange(len(system.levels), dtype=float)
            expected = np.zeros(len(v))
            for i, j, n in system.cells.collect():
                expected[i] += n * v[j]
                expected[j] += n * v[i]
            assert np.allclose(system.pairs_times(v), expected)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def gathered(monkeypatch):
    """How many rows each result had that reached the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows, to_arrow, collect = [], DataFrame.toArrow, DataFrame.collect
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: (t := to_arrow(df), rows.append(t.num_rows))[0])
    monkeypatch.setattr(DataFrame, "collect", lambda df: (t := collect(df), rows.append(len(t)))[0])
    return rows


def test_levels_of_the_largest_column_stay_off_the_driver(spark, gathered):
    df = spark.range(60_000).select(
        (F.col("id") % 20_000).alias("g"), (F.xxhash64("id") % 7).alias("h"), (F.xxhash64("id", F.lit(1)) % 1000 / 1000.0).alias("x")
    )
    df = df.withColumn("y", 2.0 * F.col("x") + (F.col("g") % 100) / 100.0 + F.when(F.col("h") == 3, 5.0).otherwise(0.0))
    model = ols_many_levels(df, "y", ["x"], ["g", "h"])
    assert model.coefficient("x") == pytest.approx(2.0, abs=1e-9)
    assert model.coefficient("h_3") - model.coefficient("h_4") == pytest.approx(5.0, abs=1e-9)
    assert model.coefficient("g_70") - model.coefficient("g_12345") == pytest.approx(0.25, abs=1e-9)
    with pytest.raises(ValueError):
        model.coefficient("g_0")
    assert len(model.terms) == 1 + 19_999 + 12
    assert max(gathered) < 100
    table = {r["term"]: r["estimate"] for r in model.table(spark).where("term in ('_cons', 'x', 'g_70', 'h_3')").toArrow().to_pylist()}
    assert table == {"_cons": model.intercept} | {n: model.coefficient(n) for n in ("x", "g_70", "h_3")}
    assert max(gathered) < 100


@pytest.mark.parametrize("columns", [["a"], ["a", "b"], ["b", "a", "c"]])
def test_blocks_of_few_cells_equal_the_dense_solution(spark, monkeypatch, columns):
    """Levels longer than a block and a batch, missing ones and odd names, in columns of any order."""
    from gramwise.operators import iterative

    monkeypatch.setattr(iterative, "BLOCK_CELLS", 30)
    rng = np.random.default_rng(11)
    n = 2500
    frame = pd.DataFrame({"x": rng.normal(size=n), "a": np.where(rng.random(n) < 0.3, "hot", rng.integers(0, 60, n).astype(str))})
    frame["a"] = frame["a"].replace({"7": "nan", "8": "\0z", "9": "", "10": None})
    frame["b"] = rng.integers(0, 45, n).astype(str)
    frame["c"] = rng.choice(["u", "v", None], n)
    frame["y"] = 1.5 * frame.x + (frame.a == "hot") + (frame.b == "3") * 2.0 + rng.normal(0, 0.3, n)
    df = spark.createDataFrame(frame).repartition(5)
    names, design = ["_cons", "x"], [np.ones(n), frame.x]
    for c in columns:
        values = frame[c].tolist()
        present = sorted({v for v in values if isinstance(v, str)})
        for v in present[1:]:
            names.append(f"{c}_{v}")
            design.append([u == v for u in values])
        if len(present) < len({str(v) for v in values}):
            names.append("a_nan_" if c == "a" else f"{c}_nan")
            design.append([not isinstance(u, str) for u in values])
    dense = dict(zip(names, np.linalg.lstsq(np.column_stack(design).astype(float), frame.y, rcond=None)[0], strict=True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        model = ols_many_levels(df, "y", ["x"], columns)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = _by_name(model)
    assert list(found) == [*names[1:], "_cons"]
    for name in dense:
        assert found[name] == pytest.approx(dense[name], rel=1e-8, abs=1e-8), name
    for name in ("a_nan", "a_nan_", "a_\0z", "x"):
        assert model.coefficient(name) == pytest.approx(dense[name], rel=1e-8, abs=1e-8)
    assert model.table(spark).count() == len(dense)


def test_collinear_levels_predict_alike(spark):
    """A column given by the levels of another, and parts of the table that share no level."""
    rng = np.random.default_rng(12)
    n = 3000
    part = rng.integers(0, 3, n)
    frame = pd.DataFrame({"x": rng.normal(size=n), "g": 50 * part + rng.integers(0, 50, n), "h": 9 * part + rng.integers(0, 9, n)})
    frame["z"] = (frame.g % 4).astype(float)
    frame["y"] = 3.0 * frame.x + frame.g / 7 + frame.h + rng.normal(0, 0.1, n)
    df = spark.createDataFrame(frame).repartition(4)
    model = ols_many_levels(df, "y", ["x", "z"], ["g", "h"])
    dummies = pd.get_dummies(frame[["g", "h"]].astype(str)).to_numpy(float)
    design = np.column_stack([np.ones(n), frame.x, frame.z, dummies])
    w = np.linalg.lstsq(design, frame.y, rcond=None)[0]
    assert model.coefficient("x") == pytest.approx(w[1], abs=1e-9)
    shown = df.select("x", "z", "g", "h", model.predict().alias("p")).toPandas()
    expected = pd.Series(design @ w, index=pd.MultiIndex.from_frame(frame[["x", "z", "g", "h"]]))
    np.testing.assert_allclose(shown.p, expected[pd.MultiIndex.from_frame(shown[["x", "z", "g", "h"]])].to_numpy(), atol=1e-8)


def test_vectors_of_many_segments(spark):
    """More levels of both columns than a task sends in a row."""
    def draw(seed, n):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))

    df = spark.range(150_000).select(draw(1, 9_000).alias("g"), draw(2, 5_003).alias("h"), (draw(3, 1000) / 1000.0).alias("x"))
    df = df.withColumn("y", F.col("x") - F.col("g") / 1000 + F.col("h") / 100)
    model = ols_many_levels(df, "y", ["x"], ["h", "g"], tolerance=1e-10)
    found = _by_name(model)
    assert found["x"] == pytest.approx(1.0, abs=1e-8)
    assert found["h_4999"] - found["h_100"] == pytest.approx(48.99, abs=1e-6)
    assert found["g_8000"] - found["g_200"] == pytest.approx(-7.8, abs=1e-6)
    assert len(found) == 2 + 9_000 + 5_003 - 2
