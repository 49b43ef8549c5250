"""Splits, folds, indicators and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramwise.functions.columns import NULL_LEVEL, in_level_order, indicator, level_names
from gramwise.operators.prepare import nan_to_null
from gramwise.operators.summary import categories

MAX_LEVELS = 10_000

NULL_KEY = "\\N"  # how a missing key is written before it is hashed


def key_hash(keys: Sequence[str]) -> Column:
    """32 bits of a digest of the row's keys, of any type and number: the same wherever and by whatever engine it is computed.

    A missing key counts as a value, so every row has a hash.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit(NULL_KEY)) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def is_test(keys: Sequence[str], percent: int = 20) -> Column:
    """True for about ``percent`` of the rows, the same rows in every run and for every partitioning."""
    return key_hash(keys) % 100 < percent


def _reached(counts: DataFrame, left: int) -> tuple[int, int]:
    """Where ``left`` rows are used up in the order of ``at``, and how many of them are taken there."""
    for at, n in counts.orderBy("at").toArrow().to_pandas()[["at", "n"]].itertuples(index=False):
        if left <= n:
            return int(at), left
        left -= int(n)
    raise AssertionError("more rows than were counted")


def _cut(rows: DataFrame, number: Column, bits: int, left: int) -> tuple[int, int]:
    """The ``left``-th smallest of non-negative numbers, and how many rows are taken at it: a histogram for every 16 bits."""
    found = 0
    for shift in range(bits - 16, -1, -16):
        part = F.shiftright(number, shift)
        inside = rows if shift == bits - 16 else rows.where(F.shiftright(number, shift + 16) == found)
        found, left = _reached(inside.groupBy(part.alias("at")).agg(F.count("*").alias("n")), left)
    return found, left


def exact_split(df: DataFrame, keys: Sequence[str], percent: int = 20, out: str = "is_test") -> DataFrame:
    """Adds a flag that is true for exactly ``ceil(n * percent / 100)`` rows: those with the smallest digests, then the smallest keys.

    The digest of the last row is found by histograms of 65,536 intervals, so no row is sorted or sent.  Of rows whose keys are all
    equal, at the limit, those with the smallest hash of the whole row are taken; rows that differ in nothing are counted and written
    out again with their flags.
    """
    digest = key_hash(keys)
    left = -(-df.count() * percent // 100)
    if not left:
        return df.withColumn(out, F.lit(False))
    limit, left = _cut(df.select(digest.alias("digest")), F.col("digest"), 32, left)
    flag = digest < limit
    # Keys that share one digest of 32 bits: a handful, counted before they are sent.
    names = [f"k{i}" for i in range(len(keys))]
    shared = df.where(digest == limit).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    for tie in shared.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect():
        same = digest == limit
        for key, name in zip(keys, names, strict=True):
            same = same & F.col(key).eqNullSafe(F.lit(tie[name]))
        if left < tie["n"]:
            break
        flag, left = flag | same, left - tie["n"]
    if not left:
        return df.withColumn(out, flag)
    whole = F.xxhash64(*df.columns).bitwiseAND(F.lit((1 << 63) - 1))
    rows = df.where(same).select(whole.alias("whole"))
    last, left = _cut(rows, F.col("whole"), 64, left)
    at_limit = F.coalesce(same & (whole == last), F.lit(False))
    rest = df.where(~at_limit).withColumn(out, flag | F.coalesce(same & (whole < last), F.lit(False)))
    equal = df.where(at_limit).groupBy(*df.columns).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*df.columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    copies = equal.withColumn("__before", before).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    return rest.unionByName(copies.select(*df.columns, (F.col("__before") + F.col("__copy") <= left).alias(out)))


def fold_of(keys: Sequence[str], folds: int) -> Column:
    """Fold 0 … folds-1; independent of ``is_test``, which uses the remainder that is divided away here."""
    return F.pmod(F.call_function("div", key_hash(keys), F.lit(100)), F.lit(folds)).cast("int")


def split_group(keys: Sequence[str], folds: int, percent: int = 20) -> Column:
    """Fold number for training rows and -1 for test rows: one grouping key serves fit, tuning and scoring."""
    return F.when(is_test(keys, percent), F.lit(-1)).otherwise(fold_of(keys, folds))


def vocabulary(df: DataFrame, columns: Sequence[str], most: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted categories per column.  Gathers at most ``most`` and refuses beyond that: ``one_hot`` makes a column of each.

    ``operators.iterative`` fits models over more categories without such columns.
    """
    found = categories(df, columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} categories in {', '.join(columns)}")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in found:
        text = row["category"]
        levels[row["variable"]].append(NULL_LEVEL if text is None else "\0" * text.startswith("\0") + text)
    return {c: in_level_order(values) for c, values in levels.items()}


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Indicator columns ``<column>_<category>`` for every category but the first.

    A category that is not in ``levels`` gets zeros throughout, which is the base level.
    """
    indicators = {
        f"{column}_{level_names(values)[value]}": indicator(F.col(column), value)
        for column, values in levels.items()
        for value in values[1:]
    }
    return df.withColumns(indicators) if indicators else df


@dataclass(frozen=True)
class Scaler:
    """Column means and population standard deviations learned from one table, applied to another."""

    mean: dict[str, float]
    sd: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        stats = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
        row = nan_to_null(df.select(*columns)).agg(*stats).first()
        if any(row[f"mean_{c}"] is None for c in columns):
            raise ValueError("cannot scale columns without values")
        return cls({c: row[f"mean_{c}"] for c in columns}, {c: row[f"sd_{c}"] or 1.0 for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.sd[c]) for c, m in self.mean.items()})
