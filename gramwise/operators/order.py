"""Statistics that need a total order, without putting all rows into one task."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramwise.functions.columns import bucket_above
from gramwise.operators.prepare import complete_cases
from gramwise.operators.report import small_frame

ROWS_PER_BIN = 1_000_000
ROWS_PER_RANGE = 100_000
#: Sorted ranges of a walk at most; each sends keys for the choice of the cuts, so more of them cost the driver memory.
MAX_RANGES = 1_000
_LARGEST = float(np.finfo(float).max)


def _histogram(x: DataFrame, cuts: Iterable[float]) -> list:
    """Rows, smallest and largest value of every non-empty interval between the cuts, in order."""
    return (
        bucket_above(x, "x", sorted(cuts), "bin")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .orderBy("bin")
        .collect()
    )


def _subdivide(low: float, high: float, pieces: int) -> set[float]:
    """Cuts inside [low, high]; the first ones set the smallest value apart, so that a cut always gains."""
    below = float(np.nextafter(low, -np.inf))
    # Halved first: the width of the widest interval is no double.
    even = (2.0 * float(c) for c in np.linspace(low / 2, high / 2, pieces))
    return {c for c in (below, high, *(c for c in even if c < high)) if math.isfinite(c)}


def _values(df: DataFrame, column: str) -> DataFrame:
    """The values that are not missing; infinities count as the largest numbers there are."""
    x = F.col(column).cast("double")
    finite = F.when(x > _LARGEST, _LARGEST).when(x < -_LARGEST, -_LARGEST).otherwise(x)
    return complete_cases(df.select(F.when(F.isnan(x), x).otherwise(finite).alias("x")))


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int], bins: int = 2048) -> dict[int, float]:
    """Exact order statistics (1 = smallest) by repeated histograms.

    Every pass counts the rows between cut points and narrows each wanted rank to one bin, until a bin holds a
    single value.  Only the histograms are shuffled, so neither sorting nor a frequent value costs anything;
    a handful of passes resolves all the digits of a double.
    """
    x = _values(df, column)
    whole = x.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).first()
    bad = [r for r in ranks if not 1 <= r <= whole["n"]]
    if bad:
        raise ValueError(f"rank {bad[0]} of {whole['n']} rows")
    bracket = {r: (whole["low"], whole["high"]) for r in ranks}
    while any(low < high for low, high in bracket.values()):
        below = 0
        for row in _histogram(x, set().union(*(_subdivide(*b, bins) for b in set(bracket.values())))):
            for r in ranks:
                if below < r <= below + row["n"]:
                    bracket[r] = (row["low"], row["high"])
            below += row["n"]
    return {r: bracket[r][0] for r in ranks}


def balanced_ranges(x: DataFrame, pieces: int) -> tuple[list[float], list[int]]:
    """Cut points between ranges of about equal size, and the exact number of rows below each range.

    Starts from even cuts and divides the ranges that hold too many rows, counting again after each round.  A
    range with a single value is never divided.  Small neighbours are joined, so there are about two times
    ``pieces`` ranges at most.
    """
    whole = x.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).first()
    most = max(whole["n"] / pieces, 1.0)
    cuts = _subdivide(whole["low"], whole["high"], 2 * pieces)
    while True:
        table = _histogram(x, cuts)
        crowded = [r for r in table if r["n"] > most and r["low"] < r["high"]]
        if not crowded:
            break
        spare = 8 * pieces // len(crowded)
        cuts = {r["high"] for r in table}.union(
            *(_subdivide(r["low"], r["high"], max(spare, 2 * math.ceil(r["n"] / most))) for r in crowded)
        )
    ends, starts, size, below = [], [0], 0, 0
    for i, row in enumerate(table):
        size += row["n"]
        below += row["n"]
        if i + 1 < len(table) and size + table[i + 1]["n"] > most:
            ends.append(row["high"])
            starts.append(below)
            size = 0
    return ends, starts


def quantiles(df: DataFrame, column: str, n: int, probabilities: Sequence[float]) -> list[float]:
    """Quantiles as the inverse distribution function, averaged where it jumps (``n`` rows are not null)."""
    pairs = []
    for p in probabilities:
        position = n * p
        whole = round(position)
        if abs(position - whole) < 1e-9 * max(position, 1.0):
            pairs.append((max(whole, 1), min(whole + 1, n)))
        else:
            up = min(max(math.ceil(position), 1), n)
            pairs.append((up, up))
    found = order_statistics(df, column, sorted({r for pair in pairs for r in pair}))
    return [(found[a] + found[b]) / 2.0 for a, b in pairs]


def value_ranks(
    df: DataFrame,
    column: str,
    rows: int | None = None,
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """Distinct values with their count ``n`` and the number of rows ``before`` them in ascending order.

    Equal values are combined before the shuffle, so a value held by a third of the rows is one row here.  The
    values are cut into ranges of similar size, whose exact positions are known from the histogram that chose
    them; each range is then ranked by itself.  ``rows`` saves a pass when the number of values is known.
    """
    x = _values(df, column)
    total = x.count() if rows is None else rows
    bins = max(1, math.ceil(total / rows_per_bin))
    values = x.groupBy("x").agg(F.count("*").alias("n"))
    cuts, starts = balanced_ranges(x, bins) if total else ([], [0])
    inside = Window.partitionBy("bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    position = small_frame(df.sparkSession, "bin int, start bigint", list(enumerate(starts)))
    ranked = bucket_above(values, "x", cuts, "bin").withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(position, "bin").select(
        F.col("x").alias("value"), "n", (F.col("start") + F.col("inside")).alias("before")
    )


def _check_names(keys: Sequence[str], column: str) -> None:
    if column in keys:
        raise ValueError("the residual cannot be part of the order")


def durbin_watson(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    rows: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Sum of squared differences of neighbours over the sum of squares, in the order of the key columns.

    Rows with equal keys are ordered by the value itself, and rows equal in both are combined first: their
    differences are zero.  Spark range-partitions and sorts; every task walks its range once and returns one
    row, and the differences across neighbouring ranges are added from those rows.  The number of ranges
    follows the number of rows, which ``rows`` gives if it is known, up to ``MAX_RANGES``: beyond, ranges are longer.
    """
    _check_names(order_by, column)
    present = complete_cases(df.select(*order_by, F.col(column).cast("double").alias("__e")), ["__e"])
    total = present.count() if rows is None else rows
    combined = present.groupBy(*order_by, "__e").agg(F.count("*").cast("double").alias("__n"))
    keys = [*[F.col(k).asc_nulls_last() for k in order_by], F.col("__e").asc()]
    ranges = min(MAX_RANGES, max(1, math.ceil(total / rows_per_range)))
    sorted_rows = combined.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("__e", "__n")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        first = last = None
        steps = squares = 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            e = batch.column(0).to_numpy()
            squares += float(e * e @ batch.column(1).to_numpy())
            steps += float(np.sum(np.diff(e) ** 2))
            if last is None:
                first = float(e[0])
            else:
                steps += float((e[0] - last) ** 2)
            last = float(e[-1])
        if last is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "first": [first], "last": [last], "steps": [steps], "squares": [squares]},
                schema=pa.schema(
                    [("part", pa.int32()), *((n, pa.float64()) for n in ("first", "last", "steps", "squares"))]
                ),
            )

    walked = sorted_rows.mapInArrow(walk, "part int, first double, last double, steps double, squares double")
    jump = F.col("first") - F.lag("last").over(Window.orderBy("part"))  # one row per range
    return walked.withColumn("jump", F.coalesce(jump * jump, F.lit(0.0))).agg(
        F.try_divide(F.sum(F.col("steps") + F.col("jump")), F.sum("squares")).alias("durbin_watson")
    )
