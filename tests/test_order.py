import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramwise.operators import diagnose, order
from gramwise.operators.gram import gram_table
from gramwise.operators.ols import ols, with_residuals
from gramwise.operators.order import balanced_ranges, durbin_watson, order_statistics, quantiles, value_ranks


def _hot(n=3000, seed=5):
    """Values of which a third are the same."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    x[: n // 3] = 0.25
    return rng.permutation(x)


@pytest.mark.parametrize("bins", [4, 2048])
def test_order_statistics(spark, bins):
    x = _hot()
    x[:5] = [1e300, -1e300, 0.0, -0.0, 5e-324]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(6)
    ranks = [1, 2, 750, 1400, 2250, 2999, 3000]
    got = order_statistics(df, "x", ranks, bins)
    assert [got[r] for r in ranks] == list(np.sort(x)[np.array(ranks) - 1])
    with pytest.raises(ValueError, match="rank 3001"):
        order_statistics(df, "x", [3001])


@pytest.mark.parametrize("n", [8, 9, 10, 11, 301])
def test_quantiles(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    expected = np.quantile(x, [0.25, 0.5, 0.75], method="averaged_inverted_cdf")
    assert quantiles(df, "x", n, [0.25, 0.5, 0.75]) == pytest.approx(list(expected))


@pytest.mark.parametrize("rows_per_bin", [50, 1000, 1_000_000])
def test_value_ranks(spark, rows_per_bin):
    x = _hot()
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(6)
    rows = value_ranks(df, "x", rows_per_bin=rows_per_bin).collect()
    assert len(rows) == len(np.unique(x))
    for r in rows:
        assert r["n"] == np.sum(x == r["value"]) and r["before"] == np.sum(x < r["value"])


def test_balanced_ranges(spark):
    x = np.concatenate([_hot(), np.random.default_rng(6).lognormal(0, 4, 2000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(6)
    cuts, starts = balanced_ranges(df, 20)
    assert len(starts) == len(cuts) + 1 <= 60
    assert starts == [0, *(int(np.sum(x <= c)) for c in cuts)]
    edges = [-np.inf, *cuts, np.inf]
    for low, high in zip(edges, edges[1:]):
        inside = x[(x > low) & (x <= high)]
        assert 0 < len(inside) and (len(inside) <= len(x) / 20 or len(np.unique(inside)) == 1)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_durbin_watson(spark, partitions):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"a": rng.choice(["x", "y", "z"], 900, p=[0.6, 0.2, 0.2]), "b": rng.integers(0, 90, 900)})
    frame["e"] = rng.normal(size=900)
    frame = pd.concat([frame, frame[frame.a == "x"].iloc[:50], frame[frame.a == "x"].iloc[:50]])
    ordered = frame.sort_values(["a", "b", "e"]).e.to_numpy()
    expected = np.sum(np.diff(ordered) ** 2) / np.sum(ordered**2)
    df = spark.createDataFrame(frame).repartition(partitions)
    assert durbin_watson(df, "e", ["a", "b"], rows_per_range=1000 // partitions).first()[0] == pytest.approx(expected, rel=1e-12)


def test_shapiro_wilk_on_a_normal_and_a_skewed_sample(spark):
    rng = np.random.default_rng(11)
    normal = spark.createDataFrame(pd.DataFrame({"residual": rng.normal(size=500)}))
    skewed = spark.createDataFrame(pd.DataFrame({"residual": rng.exponential(size=500)}))
    assert diagnose.shapiro_wilk(normal).first()["p"] > 0.05
    assert diagnose.shapiro_wilk(skewed).first()["p"] < 1e-10
    many = spark.createDataFrame(pd.DataFrame({"residual": rng.normal(size=2500)}))
    row = diagnose.shapiro_wilk(many).first()
    assert 0.99 < row["w"] <= 1 and row["p"] is None
    assert diagnose.shapiro_francia(many).first()["p"] is not None
    with pytest.raises(ValueError, match="equal"):
        diagnose.shapiro_wilk(spark.createDataFrame([(1.0,)] * 5, "residual double"))


@pytest.mark.parametrize("hot", [False, True])
def test_density(spark, hot):
    x = _hot() if hot else np.random.default_rng(4).gamma(2.0, size=777)
    df = spark.createDataFrame(pd.DataFrame({"residual": x})).repartition(4)
    rows = diagnose.density(df).toPandas()
    q1, q3 = np.quantile(x, [0.25, 0.75], method="averaged_inverted_cdf")
    h = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.349) * len(x) ** -0.2
    assert rows.point.iloc[0] == pytest.approx(x.min() - h) and rows.point.iloc[-1] == pytest.approx(x.max() + h)
    z = (rows.point.to_numpy()[:, None] - x[None, :]) / h
    kernel = np.where(np.abs(z) < 5**0.5, 0.75 * (1 - z * z / 5) / 5**0.5, 0)
    np.testing.assert_allclose(rows.density, kernel.sum(axis=1) / (len(x) * h), atol=1e-10)
    if not hot:
        assert np.trapezoid(rows.density, rows.point) == pytest.approx(1.0, abs=0.03)


def test_density_of_few_points(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0)], "residual double")
    assert diagnose.density(df).count() == 4


def test_residual_shape(spark):
    x = np.random.default_rng(9).normal(size=300) ** 3
    shape = diagnose.residual_shape(spark.createDataFrame(pd.DataFrame({"residual": x})))
    d = x - x.mean()
    assert shape["skew"] == pytest.approx(np.mean(d**3) / np.mean(d**2) ** 1.5)
    assert shape["kurtosis"] == pytest.approx(np.mean(d**4) / np.mean(d**2) ** 2)
    assert shape["omnibus_p"] == pytest.approx(np.exp(-shape["omnibus"] / 2))


def test_binned_pairs_keep_every_row(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"x": rng.normal(size=1000), "y": rng.normal(size=1000)})
    rows = diagnose.binned_pairs(spark.createDataFrame(frame), "x", "y", 10).toPandas()
    assert rows.n.sum() == 1000
    assert rows.x_bin.between(0, 9).all() and rows.y_bin.between(0, 9).all()
    assert rows.x_min.iloc[0] == frame.x.min() and rows.y_max.iloc[0] == frame.y.max()


def test_im_test_finds_heteroskedasticity(spark):
    rng = np.random.default_rng(12)
    x = rng.uniform(1, 3, 600)
    frames = {
        "even": pd.DataFrame({"x": x, "y": x + rng.normal(size=600)}),
        "uneven": pd.DataFrame({"x": x, "y": x + rng.normal(size=600) * x**2}),
    }
    p = {}
    for name, frame in frames.items():
        df = spark.createDataFrame(frame)
        fit = ols(df, "y", ["x"])
        table = diagnose.im_test(df, fit, gram_table(df, ["x", "y"]).moments())
        p[name] = {r["source"]: (r["p"], r["df"]) for r in table.collect()}
    assert p["uneven"]["heteroskedasticity"][0] < 1e-6 < 0.01 < p["even"]["heteroskedasticity"][0]
    assert p["even"]["heteroskedasticity"][1] == 2 and p["even"]["total"][1] == 4


def test_durbin_watson_of_a_trend_is_small(spark):
    frame = pd.DataFrame({"t": np.arange(400), "y": np.sin(np.arange(400) / 40)})
    df = spark.createDataFrame(frame)
    assert durbin_watson(with_residuals(df, ols(df, "y", ["t"])), "residual", ["t"]).first()[0] < 0.05


def test_durbin_watson_ranges_are_longer_beyond_the_most(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("t"), F.hash("id").cast("double").alias("e"))
    asked, plain = [], type(df).repartitionByRange
    monkeypatch.setattr(order, "MAX_RANGES", 4)
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *keys: asked.append(n) or plain(self, n, *keys))
    found = durbin_watson(df, "e", ["t"], rows_per_range=5).first()[0]
    e = np.array([r["e"] for r in df.orderBy("t").collect()])
    assert asked == [4]
    assert found == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum(), rel=1e-12)
