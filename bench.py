"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.  Every query runs twice, from the
Parquet files to the collected result; the faster run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gramwise.operators.features import split_group  # noqa: E402
from gramwise.operators.forest import forest_cv  # noqa: E402
from gramwise.operators.gram import gram_table  # noqa: E402
from gramwise.plans import panel as pl  # noqa: E402
from gramwise.operators import scenario  # noqa: E402
from gramwise.plans.catalog import ELASTICITY, MARGIN_AT_ZERO, MARGIN_SLOPE, PANEL_YEARS, QUERIES  # noqa: E402
from gramwise.sources.tables import SALES_CATEGORIES, SALES_KEYS, macro_table, sales, score_table  # noqa: E402

HEADLINES = (
    "discount_cap_sweep", "quarter_margin", "ols_margin", "lasso_margin", "whatif_profit", "durbin_watson",
    "shapiro_francia", "panel_join", "summarize", "ols_full", "vif_full", "im_test", "residual_density", "shapiro_wilk",
)


_cached: dict = {}


def six_table_join(spark: SparkSession, sf: str) -> None:
    """The joined order lines with all categories, cached and counted."""
    lines = sales(spark, sf, *SALES_KEYS, "sales", "discount", "profit", "margin", *SALES_CATEGORIES).cache()
    lines.count()
    lines.unpersist()


def gram_15_folds(spark: SparkSession, sf: str) -> None:
    """Cross products of 42 features in 15 folds and a test part, joins included."""
    lines = sales(spark, sf, *SALES_KEYS, "discount", "margin", *SALES_CATEGORIES)
    gram_table(lines, ["discount", "margin"], SALES_CATEGORIES, split_group(SALES_KEYS, 15))


def sweep_cached(spark: SparkSession, sf: str) -> None:
    """The sweep of 81 caps on cached order lines, collected: like the probe, without the scan."""
    if "lines" not in _cached:
        _cached["lines"] = sales(spark, sf, "sales", "discount", "profit").cache()
        _cached["lines"].count()
    margin = scenario.constant_margin(MARGIN_SLOPE, MARGIN_AT_ZERO)
    scenario.cap_sweep(_cached["lines"], scenario.cap_grid(), margin, ELASTICITY).collect()


def forest_100_trees(spark: SparkSession, sf: str) -> None:
    """One forest of 100 trees, depth 30, on the panel (two folds of the same setting, then the refit)."""
    panel = pl.build_panel(macro_table(spark, sf), score_table(spark, sf), *PANEL_YEARS)
    rows = panel.withColumn("fold", F.col("Year") % 2)
    forest_cv(rows, "score", pl.REGRESSORS, "fold", ["Country", "Year"], 2, trees=(100,), subsets=("sqrt",))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
        # The fact tables are a few megabytes here: do not broadcast what would never be small at full size.
        .config("spark.sql.autoBroadcastJoinThreshold", "1MB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: (lambda s, d, q=QUERIES[name]: q(s, d).collect()) for name in HEADLINES}
    runs |= {f.__name__: f for f in (six_table_join, gram_15_folds, sweep_cached, forest_100_trees)}
    seconds: dict[str, float] = {}
    for name, run in runs.items():
        times = []
        for _ in range(2):
            start = time.perf_counter()
            run(spark, sf)
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
