"""Registered queries against their SQL on the smallest tables, and the shape of their plans."""

import contextlib
import io
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
# The published grid takes minutes; tests/test_forest.py fits small ones.
SLOW = {"forest_grid", "forest_importance", "forest_holdout", "forest_pairs", "forest_study", "forest_out_of_bag"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def _plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    verdict = compare(queries()[name](spark, SF), duck, oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_query_without_sql_runs(spark, name):
    queries()[name](spark, SF).collect()


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 81
    assert df.columns[0] == "discount_cap"


def test_sweep_reads_three_columns_and_makes_no_product(spark):
    plan = _plan(queries()["discount_cap_sweep"](spark, SF))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "partial_sum" in plan


def test_year_range_reaches_both_tables(spark):
    """Each side is filtered on its year before the join."""
    from gramwise.plans import panel as pl

    a = spark.createDataFrame([(2011, "x", "Low income", 1.0)], "year int, country_name string, income_group string, v double")
    b = spark.createDataFrame([(2011, "x", 5.0)], "c0 int, c1 string, c2 double")
    plan = _plan(pl.build_panel(a, b, 2011, 2020))
    assert plan.count(">= 2011") >= 2 and plan.count("<= 2020") >= 2


def test_no_registered_plan_has_a_product(spark):
    for name in ("quarter_margin", "profit_curve", "panel_join", "actual_predicted", "whatif_profit", "lasso_margin"):
        plan = _plan(queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_dimension_is_joined_only_when_asked_for(spark):
    from gramwise.sources.tables import sales

    assert _plan(sales(spark, SF, "sales", "discount")).count("ReadSchema") == 1
    assert _plan(sales(spark, SF, "sales", "sub_category")).count("ReadSchema") == 2
    assert _plan(sales(spark, SF, "sales", "quarter")).count("ReadSchema") == 2
    assert _plan(sales(spark, SF, "sales", "region")).count("ReadSchema") == 5


def test_read_csv_by_name_needs_no_inference(spark, tmp_path):
    from gramwise.sources.csv import read_csv

    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert "y" not in _plan(read_csv(spark, str(tmp_path), {"x": "int"})).split("ReadSchema")[1].split("\n")[0]


def test_residual_scatter_reads_the_tables_once(spark):
    """The cells are counted while the cross-section is kept: the result reads no table again."""
    found = queries()["residual_scatter"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() == [] and found.columns[:3] == ["x_bin", "y_bin", "n"]
    assert dict(found.dtypes)["n"] == "bigint"
