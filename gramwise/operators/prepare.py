"""Relational preparation: checks, recoding, filters, the panel join, missing rows, ordering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}; present: {', '.join(df.columns)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark keeps NaN and null apart and lets NaN spread through sums; use null for both."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return require_columns(df, list(names)).withColumnsRenamed(dict(names))


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def project_except(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """All columns but the excluded ones; names not in the table are ignored, the rest must be numeric."""
    kept = [(name, kind) for name, kind in df.dtypes if name not in set(excluded)]
    other = [name for name, kind in kept if kind not in _NUMERIC and not kind.startswith("decimal")]
    if other:
        raise TypeError(f"not numeric: {', '.join(other)}")
    return df.select([name for name, _ in kept])


def within(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows with low <= column <= high; missing values do not qualify."""
    return df.filter(F.col(column).between(low, high))


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Inner equi-join in which the keys appear once.

    Missing keys never match unless ``null_safe``.  Any other shared column name is an error, not a suffix.
    """
    require_columns(left, keys)
    require_columns(right, keys)
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared:
        raise ValueError(f"columns on both sides: {', '.join(sorted(shared))}")
    if not null_safe:
        return left.join(right, list(keys), "inner")
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(other, condition, "inner").drop(*[f"__right_{k}" for k in keys])


def is_complete(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """True where none of the columns is null or NaN.

    One condition per column: the single condition that ``dropna`` writes makes the optimizer derive a variant
    for every subset of renamed columns, which takes minutes beyond a dozen.
    """
    kinds = dict(df.dtypes)
    complete = F.lit(True)
    for name in df.columns if columns is None else columns:
        complete = complete & F.col(name).isNotNull()
        if kinds[name] in ("double", "float"):
            complete = complete & ~F.isnan(name)
    return complete


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which none of the columns is null or NaN."""
    return df.where(is_complete(df, columns))


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows in all, rows that are complete, rows that listwise deletion would drop."""
    used = F.count_if(is_complete(df, columns))
    return df.agg(F.count("*").alias("n_rows"), used.alias("n_used"), (F.count("*") - used).alias("n_dropped"))


def sort_missing_last(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending order with missing values at the end.

    Name enough columns to make the order unique: Spark cuts its range partitions on all of them, so a single
    frequent first key does not land in one task.
    """
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc()).limit(k)


def by_magnitude(df: DataFrame, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.abs(by).desc_nulls_last(), F.col(tie).asc())
