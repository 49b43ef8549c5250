"""Cross-validated random forest regression on MLlib."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwise.operators.cache import kept
from gramwise.operators.prepare import complete_cases
from gramwise.operators.report import small_frame

# The full grid.
FULL_TREES = (100, 500, 1000)
FULL_SUBSETS = ("sqrt", "log2")

COPIES_PER_PIECE = 10_000
ROWS_PER_PARTITION = 100_000
MAX_PARTITIONS = 20_000


@dataclass(frozen=True)
class ForestCv:
    model: RandomForestRegressionModel
    features: tuple[str, ...]
    grid: tuple[tuple[int, str, float], ...]  # trees, features per split, mean squared error over the folds

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``; rows with a missing feature are left out."""
        return self.model.transform(_assembled(df, self.features)).drop("__features")

    def importances(self, spark: SparkSession) -> DataFrame:
        """Share of the impurity reduction per feature; sums to one."""
        weights = self.model.featureImportances.toArray()
        rows = list(zip(self.features, weights, strict=True))
        return small_frame(spark, "feature string, importance double", rows)

    def grid_table(self, spark: SparkSession) -> DataFrame:
        return small_frame(spark, "trees int, features string, cv_mse double", self.grid)


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__features").transform(complete_cases(df, features))


def _placed(rows: DataFrame) -> DataFrame:
    """The same rows, in partitions that depend on their content only.

    Copies are counted before they are sent and written out again in pieces that land in different partitions,
    so a row that occurs very often does not fill one of them.  The number of partitions follows the rows alone.
    """
    columns = rows.columns
    last = F.col("__copies") - 1
    pieces = F.sequence(F.lit(0).cast("bigint"), F.call_function("div", last, F.lit(COPIES_PER_PIECE)))
    size = F.least(F.lit(COPIES_PER_PIECE), F.col("__copies") - F.col("__piece") * COPIES_PER_PIECE)
    parts = min(MAX_PARTITIONS, math.ceil(rows.count() / ROWS_PER_PARTITION)) or 1
    return (
        rows.groupBy(*columns)
        .agg(F.count("*").alias("__copies"))
        .withColumn("__piece", F.explode(pieces))
        .repartition(parts, *columns, "__piece")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
        .select(*columns)
    )


def _leaf_values(model: RandomForestRegressionModel) -> tuple[np.ndarray, np.ndarray]:
    """What each leaf predicts, tree after tree with leaves from left to right, and where each tree's leaves start."""
    values, starts = [], []
    for tree, value in _LEAF.findall(model.toDebugString):
        if tree:
            starts.append(len(values))
        else:
            values.append(float(value))
    return np.array(values), np.array(starts)


_LEAF = re.compile(r"^ *Tree (\d+)|Predict: (\S+)", re.MULTILINE)


def prefix_errors(model: RandomForestRegressionModel, scored: DataFrame, sizes: Sequence[int]) -> list[float]:
    """Mean squared error over ``scored(__label, __features)`` of the forests that the first trees of ``model`` form, by their number.

    Each tree's prediction is looked up by the leaf that a row falls into; a task sends one row of sums.
    """
    values, starts = _leaf_values(model)
    shared = scored.sparkSession.sparkContext.broadcast((values, starts))
    rows = model.setLeafCol("__leaves").transform(scored).select("__label", vector_to_array("__leaves").alias("leaves"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, starts = shared.value
        squares, count = np.zeros(len(sizes)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = batch.column("leaves").values.to_numpy()[-batch.num_rows * len(starts) :].reshape(batch.num_rows, len(starts))
            sums = np.cumsum(values[leaves.astype(np.int64) + starts], axis=1)
            label = batch.column("__label").to_numpy()
            for k, size in enumerate(sizes):
                squares[k] += ((sums[:, size - 1] / size - label) ** 2).sum()
            count += batch.num_rows
        if count:
            yield pa.RecordBatch.from_pydict({"n": pa.array([count]), **{f"s{k}": pa.array([v]) for k, v in enumerate(squares)}})

    names = [f"s{k}" for k in range(len(sizes))]
    parts = rows.mapInArrow(add, "n bigint, " + ", ".join(f"{n} double" for n in names))
    row = parts.agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    shared.destroy()
    return [row[n] / row["n"] if row["n"] else math.nan for n in names]


def _tried(subset: str, features: int) -> int | str:
    """How many features MLlib tries at a split; the name of a strategy whose number is not known here."""
    known = {"sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))), "all": features}
    return known.get(subset, subset)


def forest_cv(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    fold: str,
    order: Sequence[str],
    folds: int,
    trees: Sequence[int] = FULL_TREES,
    subsets: Sequence[str] = FULL_SUBSETS,
    depth: int = 30,
    bins: int = 32,
    seed: int = 42,
    parallelism: int = 4,
) -> ForestCv:
    """Grid search over the number of trees and the features tried per split, by the folds in column ``fold``;
    the setting with the least mean squared error over the folds is refitted on all rows.

    Each fold and each feature setting is fitted once, with the most trees: the trees of a forest are independent, so
    its first 100 are a forest of 100.  MLlib draws its bootstrap samples by partition, so rows are placed by their
    content first to make the result repeatable.
    """
    rows = complete_cases(df, [label, *features]).select(
        *order, F.col(fold).cast("int").alias("__fold"), F.col(label).cast("double").alias("__label"),
        *[F.col(c).cast("double").alias(c) for c in features if c not in order],
    )
    placed = _assembled(_placed(rows).sortWithinPartitions(*order, "__label"), features)
    sizes = sorted(trees)

    def forest(count: int, subset: str) -> RandomForestRegressor:
        return RandomForestRegressor(
            featuresCol="__features", labelCol="__label", maxDepth=depth, maxBins=bins, seed=seed, numTrees=count, featureSubsetStrategy=subset,
            cacheNodeIds=True,
        )

    with kept(placed.select("__fold", "__label", "__features")) as train:

        def errors(setting: tuple[str, int]) -> list[float]:
            subset, held = setting
            model = forest(sizes[-1], subset).fit(train.where(F.col("__fold") != held))
            return prefix_errors(model, train.where(F.col("__fold") == held), sizes)

        present = [r[0] for r in train.select("__fold").distinct().where(F.col("__fold").between(0, folds - 1)).orderBy("__fold").collect()]
        # Settings that try equally many features are one forest: both of them are three for eight features.
        tried = {s: _tried(s, len(features)) for s in subsets}
        one_of = {k: s for s, k in reversed(tried.items())}
        settings = [(s, f) for s in one_of.values() for f in present]
        with ThreadPoolExecutor(parallelism) as pool:
            found = dict(zip(settings, pool.map(errors, settings), strict=True))
        scored = tuple(
            (n, s, float(np.mean([found[one_of[tried[s]], f][k] for f in present]))) for k, n in enumerate(sizes) for s in subsets
        )
        count, subset, _ = min(scored, key=lambda x: x[2])
        return ForestCv(forest(count, subset).fit(train), tuple(features), scored)


def bootstrap_weights(keys: Sequence[str], trees: int) -> Column:
    """How often a row stands in the bootstrap sample of each tree: Poisson of mean one, from a digest of the row's keys and the tree.

    The same for any partitioning and in any run.
    """
    below, total = [], 0.0
    for k in range(18):
        total += math.exp(-1.0) / math.factorial(k)
        below.append(total)
    limits = F.array(*[F.lit(x) for x in below])

    def weight(tree: Column) -> Column:
        share = F.shiftrightunsigned(F.xxhash64(*keys, tree), 11).cast("double") / float(1 << 53)
        return F.size(F.filter(limits, lambda limit: limit <= share)).cast("double")

    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), weight)


def out_of_bag(
    df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], trees: int = 100, subset: str = "sqrt", depth: int = 30,
    bins: int = 32, seed: int = 42, parallelism: int = 8, chunk: int = 20,
) -> DataFrame:
    """``*keys, label, prediction, n_trees``: every row as the trees predict it that were not fitted on it.

    Tree ``t`` is an MLlib tree fitted with its weights of ``bootstrap_weights``; rows of weight zero are out of its bag.  A row that
    every tree has seen has no prediction.  Rows with a missing feature or label are left out.
    """
    rows = complete_cases(df, [label, *features]).select(*keys, *[F.col(c).cast("double").alias(c) for c in (label, *features) if c not in keys])
    with kept(rows):
        # Every level of every tree is a job over all partitions: as many as the rows need, not as a shuffle before left.
        placed = _placed(rows).sortWithinPartitions(*keys, label)
    weighted = _assembled(placed, features).withColumn("__weights", bootstrap_weights(keys, trees))
    with kept(weighted) as train:

        def fit(t: int) -> RandomForestRegressionModel:
            tree = RandomForestRegressor(
                featuresCol="__features", labelCol=label, weightCol="__w", maxDepth=depth, maxBins=bins, seed=seed + t, numTrees=1,
                featureSubsetStrategy=subset, bootstrap=False,
            )
            return tree.fit(train.withColumn("__w", F.col("__weights")[t]).where("__w > 0"))

        with ThreadPoolExecutor(parallelism) as pool:
            models = list(pool.map(fit, range(trees)))
    sums = weighted.withColumns({"__total": F.lit(0.0), "__count": F.lit(0)})
    plain = sums.columns
    for low in range(0, trees, chunk):
        at = range(low, min(low + chunk, trees))
        scored = sums
        for t in at:
            scored = models[t].setPredictionCol(f"__p{t}").transform(scored)
        total, count = F.col("__total"), F.col("__count")
        for t in at:
            # What a row's own trees say about it does not count.
            outside = F.col("__weights")[t] == 0
            total, count = total + F.when(outside, F.col(f"__p{t}")).otherwise(0.0), count + outside.cast("int")
        sums = scored.select(*[c for c in plain if c not in ("__total", "__count")], total.alias("__total"), count.alias("__count"))
    prediction = F.try_divide(F.col("__total"), F.col("__count"))
    return sums.select(*keys, label, prediction.alias("prediction"), F.col("__count").alias("n_trees"))


def oob_error(predicted: DataFrame, label: str) -> DataFrame:
    """``n, n_predicted, mse, r2`` of out-of-bag predictions; rows without one count in ``n`` only."""
    error = F.col(label) - F.col("prediction")
    seen = F.when(F.col("prediction").isNotNull(), F.col(label))
    return predicted.agg(
        F.count("*").alias("n"), F.count("prediction").alias("n_predicted"), F.avg(error * error).alias("mse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(seen) * F.count("prediction"))).alias("r2"),
    )
