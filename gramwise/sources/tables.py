"""Parquet tables and the working tables derived from them.

The three working tables have the shapes of the analyses: order lines (``sales``), a country-year panel
(``macro_table`` and ``score_table``) and a cross-section (``cross_section``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwise.functions.columns import quarter_label, ratio

SALES_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
SALES_CATEGORIES = ("sub_category", "segment", "region", "ship_mode", "quarter")

_FROM_ORDERS = {"order_date", "quarter", "segment", "region"}
_FROM_CUSTOMER = {"segment", "region"}
_FROM_PART = {"sub_category"}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def sales(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    """Order lines with only the requested columns.

    A dimension is joined only when one of its columns is asked for.  The orders side is joined with its own
    dimensions first, so that the wide fact table is shuffled once per large key and no more.  No side is
    hinted: Spark broadcasts those whose files are under its size threshold and splits skewed partitions.
    """
    wanted = set(columns)
    lines = table(spark, directory, "lineitem")
    if wanted & _FROM_ORDERS:
        orders = table(spark, directory, "orders")
        if wanted & _FROM_CUSTOMER:
            customer = table(spark, directory, "customer")
            if "region" in wanted:
                nation = table(spark, directory, "nation")
                region = table(spark, directory, "region")
                customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
                    region, F.col("n_regionkey") == F.col("r_regionkey")
                )
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if wanted & _FROM_PART:
        part = table(spark, directory, "part")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))

    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    profit = price * (F.lit(0.5) - discount) - F.lit(10.0) * F.col("l_quantity")
    definitions: dict[str, Column] = {
        "sales": price,
        "discount": discount,
        "profit": profit,
        "margin": ratio(profit, price),
        "quantity": F.col("l_quantity"),
        "tax": F.col("l_tax"),
        "order_date": F.col("o_orderdate"),
        "sub_category": F.col("p_type"),
        "segment": F.col("c_mktsegment"),
        "region": F.col("r_name"),
        "ship_mode": F.col("l_returnflag"),
        "quarter": quarter_label(F.col("o_orderdate")),
        **{key: F.col(key) for key in SALES_KEYS},
    }
    return lines.select([definitions[c].alias(c) for c in columns])


def macro_table(spark: SparkSession, directory: str) -> DataFrame:
    """One row per country and year, named as the macro data arrive (before any renaming)."""
    orders = table(spark, directory, "orders")
    customer = table(spark, directory, "customer")
    nation = table(spark, directory, "nation")
    region = table(spark, directory, "region")
    price, balance = F.col("o_totalprice"), F.col("c_acctbal")
    cells = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.year("o_orderdate").alias("year"))
        .agg(
            F.sum(price).alias("gdp_usd"),
            F.try_divide(F.stddev(price), F.avg(price)).alias("inflation_rate"),
            F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("unemployment_rate"),
            (F.lit(100.0) * F.max(price) / F.sum(price)).alias("fdi_pct_gdp"),
            (F.avg(balance) / 1000.0).alias("healthcare_capacity_index"),
            F.avg(F.month("o_orderdate").cast("double")).alias("digital_connectivity_index"),
            F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("governance_quality_index"),
            F.avg(balance).alias("balance"),
        )
    )
    income = (
        F.when(F.col("balance") < 4200, "Low income")
        .when(F.col("balance") < 4500, "Lower middle income")
        .when(F.col("balance") < 4800, "Upper middle income")
        .otherwise("High income")
    )
    return (
        cells.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("country_name"),
            "year",
            income.alias("income_group"),
            F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_code"),
            F.col("r_name").alias("region"),
            F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("currency_unit"),
            (F.col("year") - 2000).alias("years_since_2000"),
            (F.col("year") - 1900).alias("years_since_century"),
            "gdp_usd",
            "inflation_rate",
            "unemployment_rate",
            "fdi_pct_gdp",
            "healthcare_capacity_index",
            "digital_connectivity_index",
            "governance_quality_index",
        )
    )


def score_table(spark: SparkSession, directory: str) -> DataFrame:
    """Three columns without meaningful names, as an exported sheet has them."""
    lines = table(spark, directory, "lineitem")
    supplier = table(spark, directory, "supplier")
    nation = table(spark, directory, "nation")
    # Sums by supplier come first: the key may be hot, and the join then sees one row per supplier and year.
    by_supplier = lines.groupBy("l_suppkey", F.year("l_shipdate").alias("c0")).agg(F.sum("l_extendedprice").alias("price"))
    cells = (
        by_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "c0")
        .agg(F.ln(F.sum("price")).alias("c2"))
    )
    return cells.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "c0", F.col("n_name").alias("c1"), "c2"
    )


def cross_section(spark: SparkSession, directory: str) -> DataFrame:
    """One row per customer with orders: the eight inputs of the cross-section analysis."""
    lines = table(spark, directory, "lineitem")
    orders = table(spark, directory, "orders")
    customer = table(spark, directory, "customer")
    part = table(spark, directory, "part")
    by_line = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("o_custkey")
        .agg(
            F.sum("l_quantity").alias("grants_patents"),
            (F.avg("l_discount") * 100.0).alias("randd_perc_gdp"),
            (F.avg("l_tax") * 100.0).alias("gini_coeff"),
            (F.avg("l_extendedprice") / 1e4).alias("emissions_percapita"),
            F.avg(F.col("p_size").cast("double")).alias("trade_pc_gdp"),
        )
    )
    by_order = orders.groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("population_mil"),
        F.avg("o_totalprice").alias("gdp_percapita"),
    )
    return (
        by_line.join(by_order, "o_custkey")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_custkey").alias("unit"),
            "grants_patents",
            "population_mil",
            "randd_perc_gdp",
            "gini_coeff",
            (F.col("c_acctbal") / 1000.0).alias("gdp_real_growthrate"),
            "emissions_percapita",
            "trade_pc_gdp",
            "gdp_percapita",
        )
    )
