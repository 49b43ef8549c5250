import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramwise.functions.columns import NULL_LEVEL
from gramwise.operators import features, prepare, summary
from gramwise.sources import csv


def test_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "year int, country_name string, z double")
    assert prepare.rename(df, {"year": "Year", "country_name": "Country"}).columns == ["Year", "Country", "z"]
    assert prepare.rename_by_position(df, ["A", "B", "C"]).columns == ["A", "B", "C"]
    with pytest.raises(ValueError, match="2 names for 3"):
        prepare.rename_by_position(df, ["A", "B"])
    with pytest.raises(ValueError, match="missing columns: nope"):
        prepare.rename(df, {"nope": "x"})
    assert prepare.project_except(df, ["country_name", "absent"]).columns == ["year", "z"]
    with pytest.raises(TypeError, match="country_name"):
        prepare.project_except(df, ["z"])


def test_range_is_inclusive_and_drops_null(spark):
    df = spark.createDataFrame([(y,) for y in (2010, 2011, 2020, 2021, None)], "y int")
    assert sorted(r[0] for r in prepare.within(df, "y", 2011, 2020).collect()) == [2011, 2020]


def test_join(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "x", 2.0), (None, "n", 3.0)], "k int, c string, a double")
    b = spark.createDataFrame([(1, "x", 5.0), (1, "x", 6.0), (None, "n", 7.0)], "k int, c string, b double")
    joined = prepare.inner_join(a, b, ["k", "c"])
    assert joined.columns == ["k", "c", "a", "b"]
    assert joined.count() == 4
    safe = prepare.inner_join(a, b, ["k", "c"], null_safe=True)
    assert safe.columns == ["k", "c", "a", "b"] and safe.count() == 5
    with pytest.raises(ValueError, match="both sides: a"):
        prepare.inner_join(a, b.withColumnRenamed("b", "a"), ["k", "c"])


def test_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (float("nan"), "c"), (2.0, None)], "x double, s string")
    assert prepare.complete_cases(df, ["x"]).count() == 2
    assert prepare.complete_cases(df).count() == 1
    assert tuple(prepare.missing_report(df, ["x", "s"]).first()) == (4, 1, 3)
    assert prepare.nan_to_null(df).where("x is null").count() == 2


def test_order(spark):
    df = spark.createDataFrame([("b", -3.0), ("a", 2.0), (None, 1.0), ("c", None)], "k string, v double")
    assert [r[0] for r in prepare.sort_missing_last(df, "k").collect()] == ["a", "b", "c", None]
    assert [r[1] for r in prepare.by_magnitude(df, "v", "k").collect()] == [-3.0, 2.0, 1.0, None]
    assert [r[0] for r in prepare.top_k(df, "v", 2, "k").collect()] == ["a", None]


def test_many_columns_plan_quickly(spark):
    names = [f"x{i}" for i in range(40)]
    df = spark.range(10).select(*[(F.col("id") + i).cast("double").alias(n) for i, n in enumerate(names)])
    shifted = prepare.complete_cases(df.select([(F.col(c) * 2).alias(c) for c in names]))
    assert shifted.agg(*[F.sum(c) for c in names]).first()[0] == 90.0


def test_summary_counts_per_variable(spark):
    df = spark.createDataFrame([(1.0, 4), (2.0, None), (None, 6), (float("nan"), None)], "x double, y int")
    rows = {r["variable"]: r for r in summary.summarize(df, ["x", "y"]).collect()}
    assert rows["x"]["obs"] == 2 and rows["x"]["sd"] == pytest.approx(0.5**0.5)
    assert rows["y"]["min"] == 4.0 and rows["y"]["max"] == 6.0


def test_baseline_is_a_ratio_of_sums(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (None, 10.0)], "profit double, sales double")
    row = summary.baseline_totals(df).first()
    assert (row["total_profit"], row["total_sales"], row["margin"], row["n_null"]) == (4.0, 16.0, 0.25, 1)


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7).alias("b"))
    part = features.split_group(["id", "b"], 5)
    one = {r["id"]: r["p"] for r in df.coalesce(1).select("id", part.alias("p")).collect()}
    many = {r["id"]: r["p"] for r in df.repartition(16).select("id", part.alias("p")).collect()}
    assert one == many
    assert set(one.values()) == {-1, 0, 1, 2, 3, 4}
    assert 0.15 < sum(p == -1 for p in one.values()) / 5000 < 0.25


def test_one_hot_drops_the_first_and_ignores_unknown(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "g string")
    levels = features.vocabulary(train, ["g"])
    assert levels == {"g": ["a", "b", "c"]}
    coded = features.one_hot(spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "g string"), levels)
    assert coded.columns == ["g", "g_b", "g_c"]
    assert [tuple(r)[1:] for r in coded.collect()] == [(0, 0), (1, 0), (0, 0), (0, 0)]


def test_missing_category_comes_last_in_one_hot(spark):
    train = spark.createDataFrame([("z",), (None,), ("a",)], "g string")
    levels = features.vocabulary(train, ["g"])
    assert levels == {"g": ["a", "z", NULL_LEVEL]}
    assert [tuple(r)[1:] for r in features.one_hot(train, levels).collect()] == [(1, 0), (0, 1), (0, 0)]


def test_scaler_uses_the_population_deviation_of_the_training_rows(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, constant double")
    scaler = features.Scaler.fit(train, ["x", "constant"])
    row = scaler.transform(spark.createDataFrame([(4.0, 6.0)], "x double, constant double")).first()
    assert tuple(row) == (2.0, 1.0)


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("other,Sales,Name,Year\n1,2.5,x,2011\n2,NA,nan,2012\n3,,y,null\n4,n/a,#N/A,2014\n")
    df = csv.read_csv(spark, str(path), {"Name": "string", "Sales": "double", "Year": "int"})
    assert [tuple(r) for r in df.collect()] == [("x", 2.5, 2011), (None, None, 2012), ("y", None, None), (None, None, 2014)]
    with pytest.raises(ValueError, match="no column Profit"):
        csv.read_csv(spark, str(path), {"Profit": "double"})
    path.write_text("Sales\n2.5\nlots\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        csv.read_csv(spark, str(path), {"Sales": "double"}).collect()
    assert [r[0] for r in csv.read_csv(spark, str(path), {"Sales": "double"}, bad="null").collect()] == [2.5, None]


def test_csv_round_trip(spark, tmp_path):
    frame = pd.DataFrame({"a b": [1.5, np.nan, -2.0], "t": ["x,y", 'say "z"', None]})
    df = prepare.nan_to_null(spark.createDataFrame(frame, "`a b` double, t string"))
    csv.write_csv(df, str(tmp_path / "out"), single_file=True)
    back = csv.read_csv(spark, str(tmp_path / "out"), {"a b": "double", "t": "string"})
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_csv_with_quotes_as_other_tools_write_them(spark, tmp_path):
    rows = [('Fiskars 8" Scissors, 2/Pack', 10.5), ("two\nlines", 1.0), ('"', None)]
    path = tmp_path / "given"
    path.mkdir()
    (path / "a.csv").write_text('x,y\n"Fiskars 8"" Scissors, 2/Pack",10.5\n"two\nlines",1.0\n"""",NA\n')
    found = csv.read_csv(spark, str(path), {"x": "string", "y": "double"}, multi_line=True)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
    csv.write_csv(spark.createDataFrame(rows[:1], "x string, y double"), str(tmp_path / "out"), single_file=True)
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == 'x,y\n"Fiskars 8"" Scissors, 2/Pack",10.5\n'
    again = csv.parsed(csv.lines(found), {"x": "string", "y": "double"})
    assert sorted(map(tuple, again.collect()), key=str) == sorted(rows, key=str)


def test_csv_files_with_different_headers_stop_the_query(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n2,1\n")
    with pytest.raises(Exception, match="header"):
        csv.read_csv(spark, str(tmp_path), {"x": "int", "y": "int"}).collect()


def test_splits_keep_every_row_and_use_every_key(spark):
    keys = [f"k{i}" for i in range(10)]
    rows = [tuple(None if (i >> j) & 1 and j < 2 else i % (j + 5) for j in range(10)) for i in range(2000)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in keys))
    parts = df.select(features.split_group(keys, 4).alias("part"))
    assert parts.filter("part is null").count() == 0 and parts.distinct().count() == 5
    last = spark.range(1000).select(*[F.lit(0).alias(k) for k in keys[:9]], F.col("id").alias("k9"))
    assert last.select(features.split_group(keys, 4).alias("part")).distinct().count() == 5
    texts = spark.range(1000).select(F.concat(F.lit("é "), F.col("id").cast("string")).alias("t"))
    share = texts.filter(features.is_test(["t"])).count()
    assert 150 < share < 250


def test_missing_is_no_text_level(spark):
    df = spark.createDataFrame([("nan",), (None,), ("b",)], "g string")
    levels = features.vocabulary(df, ["g"])
    assert levels == {"g": ["b", "nan", NULL_LEVEL]}
    hot = features.one_hot(df, levels)
    assert sorted(tuple(r)[1:] for r in hot.collect()) == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]


def test_names_of_levels_are_plain_and_differ(spark):
    df = spark.createDataFrame([("nan",), (None,), ("b",), ("\0missing",)], "g string")
    levels = features.vocabulary(df, ["g"])
    assert features.one_hot(df, levels).columns == ["g", "g_b", "g_nan", "g_nan_"]
    hot = features.one_hot(df, levels).collect()
    assert sorted(tuple(r)[1:] for r in hot) == [(0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)]
