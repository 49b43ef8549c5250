import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from gramwise.operators import forest
from gramwise.operators.forest import FULL_SUBSETS, FULL_TREES, bootstrap_weights, forest_cv, oob_error, out_of_bag, prefix_errors


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame(rng.uniform(size=(240, 4)), columns=["a", "b", "c", "d"])
    frame["y"] = 5 * frame.a + np.where(frame.b > 0.5, 3.0, 0.0) + rng.normal(0, 0.1, 240)
    frame["id"], frame["fold"] = range(240), np.arange(240) % 3
    return spark.createDataFrame(frame)


def test_forest(spark, planted):
    found = forest_cv(planted, "y", ["a", "b", "c", "d"], "fold", ["id"], 3, trees=(3, 8), subsets=("sqrt",), depth=8)
    grid = found.grid_table(spark).collect()
    assert [(r["trees"], r["features"]) for r in grid] == [(3, "sqrt"), (8, "sqrt")]
    weights = {r["feature"]: r["importance"] for r in found.importances(spark).collect()}
    assert sum(weights.values()) == pytest.approx(1.0)
    assert min(weights["a"], weights["b"]) > max(weights["c"], weights["d"])
    variance = planted.select(F.var_pop("y")).first()[0]
    assert min(r["cv_mse"] for r in grid) < variance
    error = F.pow(F.col("y") - F.col("prediction"), 2)
    assert found.predict(planted).agg(F.avg(error)).first()[0] < 0.3 * variance
    again = forest_cv(
        planted.repartition(5), "y", ["a", "b", "c", "d"], "fold", ["id"], 3, trees=(3, 8), subsets=("sqrt",), depth=8
    )
    assert again.grid == found.grid


def test_placement_keeps_copies_and_splits_them(spark, monkeypatch):
    monkeypatch.setattr(forest, "COPIES_PER_PIECE", 10)
    df = spark.range(60).select(F.when(F.col("id") < 45, 1).otherwise(F.col("id")).alias("a"), F.lit(2.0).alias("b"))
    placed = forest._placed(df)
    assert sorted(placed.collect()) == sorted(df.collect())


def test_full_grid():
    assert FULL_TREES == (100, 500, 1000) and FULL_SUBSETS == ("sqrt", "log2")


def test_prefixes_of_a_forest_score_as_their_trees_do(spark, planted):
    """The mean of the first trees' predictions, tree by tree, and of the whole forest as MLlib gives it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="__features").transform(planted.withColumn("__label", F.col("y")))
    model = RandomForestRegressor(featuresCol="__features", labelCol="__label", numTrees=6, maxDepth=7, seed=1).fit(rows)
    found = prefix_errors(model, rows, [1, 4, 6])
    error = lambda df: df.agg(F.avg(F.pow(F.col("__label") - F.col("prediction"), 2))).first()[0]
    assert found[2] == pytest.approx(error(model.transform(rows)))
    assert found[0] == pytest.approx(error(model.trees[0].transform(rows)))
    four = rows
    for i, tree in enumerate(model.trees[:4]):
        four = tree.setPredictionCol(f"p{i}").transform(four)
    assert found[1] == pytest.approx(error(four.withColumn("prediction", sum(F.col(f"p{i}") for i in range(4)) / 4)))


def test_bootstrap_weights_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 5).alias("k"))
    weight = bootstrap_weights(["id", "k"], 5)[3]
    a = {r["id"]: r["w"] for r in df.select("id", weight.alias("w")).collect()}
    b = {r["id"]: r["w"] for r in df.repartition(11).select("id", weight.alias("w")).collect()}
    assert a == b
    values = np.array(list(a.values()))
    assert abs(values.mean() - 1) < 0.03 and abs((values == 0).mean() - np.exp(-1)) < 0.02 and abs(values.var() - 1) < 0.05
    other = df.select(F.corr(weight, bootstrap_weights(["id", "k"], 5)[4])).first()[0]
    assert abs(other) < 0.03


def test_out_of_bag_predictions_come_from_other_trees(spark, planted):
    found = out_of_bag(planted, "y", ["a", "b", "c", "d"], ["id"], trees=12, depth=6, chunk=5)
    rows = found.collect()
    assert len(rows) == 240
    outside = planted.select("id", F.size(F.filter(bootstrap_weights(["id"], 12), lambda w: w == 0)).alias("n")).collect()
    assert {r["id"]: r["n_trees"] for r in rows} == {r["id"]: r["n"] for r in outside}
    assert all((r["prediction"] is None) == (r["n_trees"] == 0) for r in rows)
    error = oob_error(found, "y").first()
    assert error["n"] == 240 and 0.3 < error["r2"] < 1 and error["mse"] > 0


def test_out_of_bag_trees_are_fitted_on_as_few_partitions_as_the_rows_need(spark, planted, monkeypatch):
    seen, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    columns = ["a", "b", "c", "d"]
    spread, whole = (out_of_bag(x, "y", columns, ["id"], trees=2, depth=3).orderBy("id") for x in (planted.repartition(40), planted.coalesce(1)))
    assert seen == [1, 1, 1, 1]
    assert spread.collect() == whole.collect()
