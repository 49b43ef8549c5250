import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramwise.functions import columns as C
from gramwise.functions import distributions as dist


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_quarter_label(spark):
    assert _one(spark, C.quarter_label(F.col("d")), d=dt.date(2017, 11, 8)) == "Q4 2017"


def test_parse_date(spark):
    assert _one(spark, C.parse_date(F.col("t"), "M/d/yyyy"), t="11/8/2016") == dt.date(2016, 11, 8)
    assert _one(spark, C.parse_date(F.col("t"), "M/d/yyyy", bad="null"), t="soon") is None
    with pytest.raises(Exception, match="CANNOT_PARSE|DateTimeException|parse"):
        _one(spark, C.parse_date(F.col("t"), "M/d/yyyy"), t="soon")


def test_division_and_logs_of_zero_are_null(spark):
    assert _one(spark, C.ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert _one(spark, C.log_positive(F.col("a")), a=0.0) is None
    assert _one(spark, C.log_positive(F.col("a")), a=-1.0) is None
    assert _one(spark, C.log_ratio(F.col("a"), F.col("b")), a=6.0, b=2.0) == pytest.approx(math.log(3))
    assert _one(spark, C.log_ratio(F.col("a"), F.col("b")), a=6.0, b=0.0) is None


def test_cap_keeps_null(spark):
    rows = spark.createDataFrame([(0.3,), (0.1,), (None,)], "d double").select(C.cap_above(F.col("d"), 0.2))
    assert [r[0] for r in rows.collect()] == [0.2, 0.1, None]


def test_recode_unmapped_is_null(spark):
    rows = spark.createDataFrame([("Low income",), ("other",), (None,)], "g string")
    coded = rows.select(C.recode(F.col("g"), {"Low income": 0, "High income": 3}))
    assert [r[0] for r in coded.collect()] == [0, None, None]


def test_percent_change_keeps_the_sign_of_the_base(spark):
    assert _one(spark, C.percent_change(F.col("a"), F.col("b")), a=50.0, b=-100.0) == -150.0


def test_first_max_takes_the_first_of_a_tie(spark):
    rows = spark.createDataFrame([(0.3, 7.0), (0.1, 7.0), (0.2, 7.0), (0.4, 1.0)], "cap double, profit double")
    best = rows.repartition(3).agg(C.first_max(F.col("profit"), F.col("cap")).alias("b")).first()["b"]
    assert (best["at"], best["value"]) == (0.1, 7.0)


def test_count_where_ignores_null(spark):
    rows = spark.createDataFrame([(0.3,), (0.0,), (None,)], "d double")
    assert rows.agg(C.count_where(F.col("d") > 0)).first()[0] == 1


def test_round_half_even(spark):
    rows = spark.createDataFrame([(0.125, "a", 2)], "x double, s string, i int")
    assert tuple(C.round_half_even(rows, 2).first()) == (0.12, "a", 2)


def test_bucket_above_counts_the_cuts_below(spark):
    rng = np.random.default_rng(1)
    cuts = [k / 100 for k in range(81)]
    values = np.concatenate([rng.uniform(-0.2, 1.0, 500), cuts, [-0.0, 0.0]])
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    for r in C.bucket_above(rows, "x", cuts, "k").collect():
        assert r["k"] == sum(c < r["x"] for c in cuts)


def test_normal_quantile(spark):
    probabilities = [1e-12, 1e-5, 0.01, 0.07, 0.075, 0.3, 0.5, 0.9, 0.925, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in probabilities], "p double")
    for r in rows.select("p", C.normal_quantile(F.col("p")).alias("z")).collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-12)


def test_tail_probabilities_match_the_mathematics_library_of_the_jvm(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for df in (1.0, 3.0, 17.0, 250.0, 47926.0):
        for t in (0.01, 0.7, 1.9, 4.5, 12.0):
            assert dist.t_two_sided(t, df) == pytest.approx(2 * d.TDistribution(df).cumulativeProbability(-t), rel=1e-8)
    for df in (1.0, 2.0, 10.0, 43.0):
        for x in (0.2, 3.0, 18.86, 90.0):
            expected = 1 - d.ChiSquaredDistribution(df).cumulativeProbability(x)
            assert dist.chi2_upper(x, df) == pytest.approx(expected, abs=1e-12)
    for a, b in ((1.0, 4.0), (7.0, 18.0), (42.0, 5000.0)):
        for x in (0.1, 1.0, 2.5, 60.0):
            expected = 1 - d.FDistribution(a, b).cumulativeProbability(x)
            assert dist.f_upper(x, a, b) == pytest.approx(expected, abs=1e-11)
    for df in (2.0, 30.0, 4000.0):
        expected = d.TDistribution(df).inverseCumulativeProbability(0.975)
        assert dist.t_quantile(0.975, df) == pytest.approx(expected, rel=1e-6)


def test_tails_reach_their_limits_for_very_many_rows():
    for df in (1e9, 1e12, 1e13, 1e15):
        for t in (0.1, 1.96, 6.0):
            assert dist.t_two_sided(t, df) == pytest.approx(2 * dist.normal_upper(t), rel=1e-6)
        assert dist.t_quantile(0.975, df) == pytest.approx(1.959963984540054, rel=1e-6)
        assert dist.f_upper(3.0, 4, df) == pytest.approx(dist.chi2_upper(12.0, 4), rel=1e-6)


def test_tails_are_smooth_where_the_limit_takes_over():
    for t in (0.5, 1.96, 5.0):
        assert dist.t_two_sided(t, 1.999e6) == pytest.approx(dist.t_two_sided(t, 2.001e6), rel=1e-7)
