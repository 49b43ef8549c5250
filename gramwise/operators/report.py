"""Small result tables (coefficients, statistics, grids) as DataFrames."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TYPES = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _plain(value, kind: str):
    if value is None or kind in ("string", "boolean"):
        return value
    if kind == "double":
        return None if math.isnan(value) else float(value)
    return int(value)


def small_frame(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """A local relation from driver-side rows; NaN becomes null."""
    fields = [field.split() for field in schema.split(",")]
    arrays = [
        pa.array([_plain(row[i], kind) for row in rows], _TYPES[kind]) for i, (_, kind) in enumerate(fields)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[name for name, _ in fields]))


def statistics_frame(spark: SparkSession, values: Mapping[str, float]) -> DataFrame:
    return small_frame(spark, "statistic string, value double", list(values.items()))
