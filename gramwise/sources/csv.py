"""Delimited text in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The strings that mean "missing" in a delimited file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# A quote inside a quoted field is written twice.
_QUOTES = {"quote": '"', "escape": '"'}


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(header=True, **_QUOTES).csv(path).columns


def read_csv(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str],
    missing: Sequence[str] = MISSING_TOKENS,
    bad: str = "error",
    multi_line: bool = False,
) -> DataFrame:
    """Read the named columns of CSV files with a header.

    Columns are found by name and the files may hold others; files of one folder must have the same header, else the
    query stops.  Only the header is looked at before the query runs; there is no inference pass.  Missing-value
    tokens become null, then each column is cast.  A value that does not fit its type stops the query, or becomes
    null with ``bad="null"``.  Quoted fields may hold line breaks with ``multi_line``, at a price: a file is then
    read by one task.
    """
    raw = spark.read.options(header=True, inferSchema=False, enforceSchema=False, multiLine=multi_line, **_QUOTES).csv(path)
    absent = [name for name in types if name not in raw.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}; it has {', '.join(raw.columns)}")
    return _typed(raw, types, missing, bad)


def _typed(raw: DataFrame, types: Mapping[str, str], missing: Sequence[str], bad: str) -> DataFrame:
    def typed(name: str, kind: str):
        quoted = F.col("`" + name.replace("`", "``") + "`")
        value = F.when(~F.trim(quoted).isin(list(missing)), quoted)
        return (value.try_cast(kind) if bad == "null" else value.cast(kind)).alias(name)

    return raw.select([typed(name, kind) for name, kind in types.items()])


def lines(df: DataFrame) -> DataFrame:
    """The rows as ``line``: CSV text as ``write_csv`` writes it."""
    return df.select(F.to_csv(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]), _QUOTES).alias("line"))


def parsed(df: DataFrame, types: Mapping[str, str], missing: Sequence[str] = MISSING_TOKENS, bad: str = "error") -> DataFrame:
    """The columns of ``line``, in the order of ``types``, as ``read_csv`` would give them."""
    schema = ", ".join("`" + name.replace("`", "``") + "` string" for name in types)
    return _typed(df.select(F.from_csv("line", schema, _QUOTES).alias("row")).select("row.*"), types, missing, bad)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write a directory of CSV files with a header.  ``single_file`` is for small reports only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(header=True, **_QUOTES).csv(path)
