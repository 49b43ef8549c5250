"""Linear models over more categories than a dense cross-product matrix could hold.

What grows with the square of the categories, the contingency tables of their pairs, stays on the cluster; every step of a solver
multiplies it by a vector in one pass.  The driver keeps the products of numeric columns and vectors with one number per level.

Ordinary least squares keeps the column with the most levels off the driver altogether: each of its levels is solved for where its
cells are, given all the other terms, and conjugate gradients go over what is left of those.  Lasso goes from one categorical column
to the next: the dummies of one column never meet in a row, so all of its coefficients are found at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwise.functions.columns import MISSING_NAME, NULL_LEVEL, level, level_names
from gramwise.operators.cache import kept
from gramwise.operators.gram import Term, pair_sums
from gramwise.operators.ols import LinearModel
from gramwise.operators.prepare import complete_cases
from gramwise.operators.report import small_frame

#: Cells of pairs in a block of a column's levels, about; a level is never divided.
BLOCK_CELLS = 1 << 18
#: Cells in a partition of blocks: 16 for each number that its task sends in a step, within these bounds; fewer where cores would idle.
PARTITION_CELLS = 2_000_000, 8_000_000
#: Numbers of a vector that a task sends in one row.
SEGMENT = 4_096


class Levels(Sequence):
    """The terms of categorical columns, made when asked for: the texts of a column's levels are one Arrow array."""

    def __init__(self, columns: Sequence[str], values: Sequence[pa.Array], missing: Sequence[str]):
        self.columns, self.values, self.missing = list(columns), list(values), list(missing)
        self.starts = [0, *accumulate(map(len, values))]

    def __len__(self) -> int:
        return self.starts[-1]

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        i = i + len(self) if i < 0 else i
        if not 0 <= i < len(self):
            raise IndexError(i)
        c = int(np.searchsorted(self.starts, i, "right")) - 1
        return _term(self.columns[c], self.values[c][i - self.starts[c]].as_py(), self.missing[c])

    def __iter__(self) -> Iterator[Term]:
        for column, values, missing in zip(self.columns, self.values, self.missing, strict=True):
            for v in values:
                yield _term(column, v.as_py(), missing)


def _term(column: str, value: str, missing: str) -> Term:
    return Term(column, value, missing if value == NULL_LEVEL else value.removeprefix("\0"))


#: Levels that could have the name of missing values.
_LIKE_MISSING = f"^{MISSING_NAME}_*$"


def _missing_name(taken: Iterable[str]) -> str:
    return level_names([NULL_LEVEL, *taken])[NULL_LEVEL]


@dataclass(frozen=True)
class Apart:
    """A categorical column whose levels stay on the cluster, in blocks with all cells of a level."""

    column: str
    size: int  # levels
    square: float  # of the label's sum over the rows of a level, over their number, summed
    blocks: DataFrame  # value and sums (1, numeric, label) of its levels, how many cells each has, those cells' terms and rows


@dataclass(frozen=True)
class LevelSystem:
    """Cross products of a constant, numeric columns about ``shift`` and dummies; the label's products apart."""

    n: float
    numeric: tuple[Term, ...]
    levels: Levels
    shift: np.ndarray
    dense: np.ndarray  # (1 + numeric) squared
    side: np.ndarray  # levels x (1 + numeric)
    diagonal: np.ndarray  # rows of each level
    cells: DataFrame | None  # i, j, n: rows that have both levels; none where there is at most one column
    right: np.ndarray  # products of the label with all terms, the constant first
    square: float
    mean: float
    blocks: tuple[np.ndarray, ...]  # the positions of each column's levels
    apart: Apart | None = None

    def pairs_times(self, v: np.ndarray) -> np.ndarray:
        """The table of pairs, and its transpose, times a vector over the levels."""
        if self.cells is None:
            return np.zeros(len(v))
        shared = self.cells.sparkSession.sparkContext.broadcast(v)
        size = len(v)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, v = np.zeros(size), shared.value
            waiting, rows = [], 0

            def sum_up() -> None:
                nonlocal out
                i, j, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
                out += np.bincount(i, n * v[j], size) + np.bincount(j, n * v[i], size)

            for batch in batches:
                waiting.append([batch.column(k).to_numpy() for k in range(3)])
                rows += batch.num_rows
                # A sum passes over all levels, so it waits for as many cells.
                if rows >= size:
                    sum_up()
                    waiting, rows = [], 0
            if rows:
                sum_up()
            yield from _segments(out)

        out = _gathered(self.cells.mapInArrow(add, _SEGMENTS), size)
        shared.destroy()
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        """All cross products times a vector over the constant, the numeric columns and the levels."""
        k = len(self.dense)
        a, b = v[:k], v[k:]
        return np.concatenate([self.dense @ a + b @ self.side, self.side @ a + self.diagonal * b + self.pairs_times(b)])

    def explained(self, v: np.ndarray | None = None) -> np.ndarray:
        """Products of all terms with the means, by level of the column apart, of the terms times ``v``, or of the label without it."""
        size, k = len(self.right), len(self.dense)
        if self.apart is None:
            return np.zeros(size)
        shared = self.apart.blocks.sparkSession.sparkContext.broadcast(v)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, v = np.zeros(size), shared.value
            for sums, at, code, n in _read(batches, k):
                mean = (sums[:, k] if v is None else _products(sums, at, code, n, v, k)) / sums[:, 0]
                out[:k] += mean @ sums[:, :k]
                out[k:] += np.bincount(code, n * mean[at], size - k)
            yield from _segments(out)

        out = _gathered(self.apart.blocks.select(*_CELLS).mapInArrow(add, _SEGMENTS), size)
        shared.destroy()
        return out

    def estimates(self, w: np.ndarray) -> DataFrame:
        """``value`` and ``estimate`` of the levels apart, given the other coefficients: the mean of what these leave of the label."""
        k = len(self.dense)
        shared = self.apart.blocks.sparkSession.sparkContext.broadcast(w)

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column("value")
                for i, (sums, at, code, n) in enumerate(_read([batch], k)):
                    rest = sums[:, k] - _products(sums, at, code, n, shared.value, k)
                    yield pa.RecordBatch.from_pydict({"value": values[i].values, "estimate": rest / sums[:, 0]})

        return self.apart.blocks.select("value", *_CELLS).mapInArrow(solve, "value string, estimate double")

    def model(self, w: np.ndarray) -> LinearModel:
        k = len(self.dense)
        intercept = self.mean + w[0] - float(w[1:k] @ self.shift)
        return LinearModel(float(intercept), (*self.numeric, *self.levels), w[1:])


_SEGMENTS = "segment int, v array<double>"
_CELLS = ("sums", "cells", "code", "n")


def _segments(out: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A vector as rows of numbers in a row, without those that are all zero."""
    for i in range(0, len(out), SEGMENT):
        part = out[i : i + SEGMENT]
        if part.any():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([i // SEGMENT], pa.int32()), "v": pa.array([part], pa.list_(pa.float64()))})


def _gathered(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors; each segment is summed in one task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[segment] = sums.get(segment, 0.0) + v.values.to_numpy()
        for segment, v in sums.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "v": pa.array([v], pa.list_(pa.float64()))})

    out = np.zeros(size)
    found = parts.repartition("segment").mapInArrow(add, _SEGMENTS).toArrow()
    for segment, v in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        out[segment * SEGMENT : segment * SEGMENT + len(v)] = v.values.to_numpy()
    return out


def _read(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The blocks: sums by level and, for each cell, its level in the block, the other level's place and the rows."""
    for batch in batches:
        for sums, cells, code, n in zip(*(batch.column(c) for c in _CELLS), strict=True):
            sums = sums.values.to_numpy().reshape(-1, k + 1)
            yield sums, np.repeat(np.arange(len(sums)), cells.values.to_numpy()), code.values.to_numpy(), n.values.to_numpy()


def _products(sums: np.ndarray, at: np.ndarray, code: np.ndarray, n: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Products of a block's dummies with the other terms times ``v``."""
    return sums[:, :k] @ v[:k] + np.bincount(at, n * v[k:][code], len(sums))


def _blocks(cells: DataFrame, width: int, partitions: int) -> DataFrame:
    """Blocks of all levels of a column from its cells (``value``, ``code``, ``n``) and its sums (no ``code``; ``f0`` and so on)."""
    schema = "value array<string>, sums array<double>, cells array<int>, code array<int>, n array<double>"

    def block(rows: pa.Table) -> pa.RecordBatch:
        first = rows["code"].is_null().to_numpy()
        starts = np.flatnonzero(first)
        sums = np.column_stack([rows[c].to_numpy()[starts] for c in ("n", *[f"f{i}" for i in range(width - 1)])])
        others = rows.filter(pa.array(~first))
        columns = {
            "value": rows["value"].take(pa.array(starts)).combine_chunks().cast(pa.string()),
            "sums": pa.array(sums.ravel()),
            "cells": pa.array(np.diff(starts, append=len(first)) - 1, pa.int32()),
            "code": others["code"].combine_chunks(),
            "n": others["n"].combine_chunks(),
        }
        return pa.RecordBatch.from_pydict({c: pa.ListArray.from_arrays([0, len(x)], x) for c, x in columns.items()})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows < BLOCK_CELLS:
                continue
            table = pa.Table.from_batches(waiting)
            # The last level may go on in the next batch.
            last = int(np.flatnonzero(table["code"].is_null().to_numpy())[-1])
            if last:
                yield block(table.slice(0, last))
            waiting, rows = table.slice(last).combine_chunks().to_batches(), 0
        if waiting:
            yield block(pa.Table.from_batches(waiting))

    return cells.repartition(partitions, "value").sortWithinPartitions("value", F.col("code").asc_nulls_first()).mapInArrow(pack, schema)


@contextmanager
def level_system(
    df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], largest_apart: bool = False
) -> Iterator[LevelSystem]:
    """The products of ``df``'s complete rows, from one pass; the tables of pairs are cached while the block lasts.

    With ``largest_apart`` the column with the most levels is kept in blocks on the cluster and has no place among the terms.
    """
    columns = [*numeric, label]
    rows = complete_cases(
        df.select(F.lit(0).alias("__group"), *[F.col(c).cast("double").alias(c) for c in columns], *[level(F.col(c)).alias(c) for c in categorical]),
        columns,
    )
    p, kinds = len(columns), len(categorical)
    pairs = [(i, j) for i in range(kinds) for j in range(i + 1, kinds)]
    with ExitStack() as tables:
        with ExitStack() as passing:
            parts = passing.enter_context(kept(pair_sums(rows, columns, categorical)))
            whole = F.when(F.col("kind") == 0, F.col("__n"))
            means = [(F.sum(whole * F.col(f"__m{i}")) / F.sum(whole)).alias(f"s{i}") for i in range(p)]
            head = parts.agg(F.sum(whole).alias("n"), F.count_if(F.col("kind") > kinds).alias("cells"), *means).first()
            if not head["n"]:
                raise ValueError("no complete rows")
            shift = np.array([head[f"s{i}"] for i in range(p)])
            n, d = F.col("__n"), [F.col(f"__m{i}") - F.lit(float(shift[i])) for i in range(p)]
            squares = [(i, j) for i in range(p) for j in range(i, p)]
            sums = [F.sum(n).alias("n"), *[F.sum(n * d[i]).alias(f"f{i}") for i in range(p)]]
            sums += [F.sum(n * (F.col(f"__c{i}_{j}") + d[i] * d[j])).alias(f"s{i}_{j}") for i, j in squares]
            total = parts.where("kind = 0").agg(*sums).first()
            dense = np.zeros((1 + p, 1 + p))
            dense[0] = dense[:, 0] = [total["n"], *[total[f"f{i}"] for i in range(p)]]
            for i, j in squares:
                dense[1 + i, 1 + j] = dense[1 + j, 1 + i] = total[f"s{i}_{j}"]

            single = parts.where(F.col("kind").between(1, kinds)).groupBy("kind", F.col("a").alias("value")).agg(*sums[: 1 + p])
            away = None
            if largest_apart and categorical:
                single = passing.enter_context(kept(single))
                last = F.col(f"f{p - 1}")
                sizes = single.groupBy("kind").agg(F.count("*").alias("size"), F.sum(last * last / F.col("n")).alias("square")).collect()
                away = min(sizes, key=lambda r: (-r["size"], r["kind"]))
            here = [i for i in range(kinds) if away is None or i + 1 != away["kind"]]
            levels, known, side, blocks = _coded(single, [categorical[i] for i in here], [i + 1 for i in here], 1 + p)

            sides = F.when(F.lit(False), F.array(F.lit(0), F.lit(0)))
            for k, (i, j) in enumerate(pairs):
                sides = sides.when(F.col("kind") == kinds + 1 + k, F.array(F.lit(i + 1), F.lit(j + 1)))
            cells = parts.where(F.col("kind") > kinds).withColumn("sides", sides).select(
                F.col("sides")[0].alias("left"), F.col("sides")[1].alias("right"), "a", "b", F.col("__n").alias("n")
            )

            def coded(cells: DataFrame, side: str, value: str, out: str) -> DataFrame:
                return cells.join(known.select(F.col("kind").alias(side), F.col("value").alias(value), F.col("at").alias(out)), [side, value])

            table, apart = None, None
            if len(here) > 1:
                inner = coded(coded(cells, "left", "a", "i"), "right", "b", "j")
                table = tables.enter_context(kept(inner.groupBy("i", "j").agg(F.sum("n").alias("n"))))
                table.count()
            if away is not None:
                own = F.col("left") == away["kind"]
                crossed = cells.where(own | (F.col("right") == away["kind"])).select(
                    F.when(own, F.col("a")).otherwise(F.col("b")).alias("value"),
                    F.when(own, F.col("right")).otherwise(F.col("left")).alias("other"), F.when(own, F.col("b")).otherwise(F.col("a")).alias("b"), "n",
                )
                counts = coded(crossed, "other", "b", "code").groupBy("value", "code").agg(F.sum("n").alias("n"))
                whole_levels = single.where(F.col("kind") == away["kind"]).drop("kind")
                rows_ = counts.unionByName(whole_levels, allowMissingColumns=True).select("value", "code", "n", *[f"f{i}" for i in range(p)])
                cores = df.sparkSession.sparkContext.defaultParallelism
                many, (fewest, most) = head["cells"] + away["size"], PARTITION_CELLS
                partitions = max(-(-many // min(max(16 * len(levels), fewest), most)), min(cores, -(-many // 100_000)))
                packed = tables.enter_context(kept(_blocks(rows_, 1 + p, partitions)))
                packed.count()
                apart = Apart(categorical[away["kind"] - 1], away["size"], away["square"], packed)
        yield LevelSystem(
            float(total["n"]), tuple(Term(c) for c in numeric), levels, shift[:-1], dense[:-1, :-1], side[:, :-1], side[:, 0].copy(), table,
            np.concatenate([dense[:-1, -1], side[:, -1]]), float(dense[-1, -1]), float(shift[-1]), blocks, apart,
        )


def _coded(single: DataFrame, columns: Sequence[str], kinds: Sequence[int], width: int) -> tuple[Levels, DataFrame, np.ndarray, tuple[np.ndarray, ...]]:
    """Places of all levels but each column's first, as terms and as a table (``kind``, ``value``, ``at``); their sums; places by column."""
    found = single.where(F.col("kind").isin(list(kinds))).toArrow()
    spark, values, missing, sums, codes, blocks, start = single.sparkSession, [], [], [], [], [], 0
    for kind in kinds:
        mine = found.filter(pc.equal(found["kind"], kind))
        mine = mine.append_column("missing", pc.equal(mine["value"], NULL_LEVEL)).sort_by([("missing", "ascending"), ("value", "ascending")])
        missing.append(_missing_name(mine["value"].filter(pc.match_substring_regex(mine["value"], _LIKE_MISSING)).to_pylist()))
        mine = mine.slice(1)
        values.append(mine["value"].cast(pa.string()).combine_chunks())
        sums.append(np.column_stack([mine[c].to_numpy() for c in ("n", *[f"f{i}" for i in range(width - 1)])]))
        blocks.append(np.arange(start, start + len(mine)))
        codes.append(pa.table({"kind": pa.array(np.full(len(mine), kind, np.int32)), "value": values[-1], "at": pa.array(blocks[-1], pa.int32())}))
        start += len(mine)
    schema = pa.schema([("kind", pa.int32()), ("value", pa.string()), ("at", pa.int32())])
    known = spark.createDataFrame(pa.concat_tables([schema.empty_table(), *codes]))
    return Levels(columns, values, missing), known, np.concatenate([np.zeros((0, width)), *sums]), tuple(blocks)


class LevelModel(LinearModel):
    """A linear model with the levels of one column in a table on the cluster, so that the driver need not hold them.

    ``away`` has their ``value`` and ``estimate``, the base level's being zero.  Like any DataFrame it is computed when it is asked for,
    by one pass over the rows.  ``terms`` and ``coef`` gather it, once; the number of terms or a single coefficient does not need that.
    """

    def __init__(self, system: LevelSystem, w: np.ndarray, columns: Sequence[str]):
        k, away = len(system.dense), system.estimates(w)
        # Takes the estimates of all levels, and counts them, where the blocks are cached.
        found = away.agg(
            F.count("estimate").alias("n"), F.min_by(F.struct("value", "estimate"), F.struct(F.col("value") == NULL_LEVEL, "value")).alias("base")
        ).first()
        if found["n"] != system.apart.size:
            raise ArithmeticError(f"{found['n']} estimates of {system.apart.size} levels")
        value, base = found["base"]
        for name, x in {
            "intercept": float(system.mean + w[0] - w[1:k] @ system.shift + base),
            "away": system.estimates(w).withColumn("estimate", F.col("estimate") - F.lit(base)),
            "base": value, "size": found["n"], "apart": system.apart.column, "columns": tuple(columns),
            "numeric": system.numeric, "levels": system.levels, "slopes": w[1:k], "steps": w[k:],
        }.items():
            object.__setattr__(self, name, x)

    @property
    def terms(self) -> Sequence[Term]:
        return _ModelTerms(self)

    @property
    def coef(self) -> np.ndarray:
        return np.concatenate([self.slopes, self.gathered[1]])

    @cached_property
    def gathered(self) -> tuple[Levels, np.ndarray]:
        """The levels of all columns, in order, and their coefficients."""
        found = self.away.toArrow()
        found = found.append_column("missing", pc.equal(found["value"], NULL_LEVEL)).sort_by([("missing", "ascending"), ("value", "ascending")]).slice(1)
        values, missing, steps = [], [], []
        for c in self.columns:
            if c == self.apart:
                values.append(found["value"].combine_chunks())
                missing.append(self.missing)
                steps.append(found["estimate"].to_numpy())
            else:
                i = self.levels.columns.index(c)
                values.append(self.levels.values[i])
                missing.append(self.levels.missing[i])
                steps.append(self.steps[self.levels.starts[i] : self.levels.starts[i + 1]])
        return Levels(self.columns, values, missing), np.concatenate(steps)

    @cached_property
    def missing(self) -> str:
        """How the missing values of the column apart are printed."""
        taken = F.when(F.col("value").rlike(_LIKE_MISSING), F.col("value"))
        return _missing_name(self.away.agg(F.collect_set(taken)).first()[0])

    def coefficient(self, name: str) -> float:
        for t, b in zip(self.numeric, self.slopes, strict=True):
            if t.name == name:
                return float(b)
        for c in self.columns:
            if not name.startswith(f"{c}_"):
                continue
            shown = name.removeprefix(f"{c}_")
            if c == self.apart:
                value = NULL_LEVEL if shown.startswith(MISSING_NAME) and shown == self.missing else _value(shown)
                found = self.away.where((F.col("value") == value) & (F.col("value") != self.base)).first()
                if found:
                    return found["estimate"]
            else:
                i = self.levels.columns.index(c)
                value = NULL_LEVEL if shown == self.levels.missing[i] else _value(shown)
                at = pc.index(self.levels.values[i], value).as_py()
                if at >= 0:
                    return float(self.steps[self.levels.starts[i] + at])
        raise ValueError(f"no term {name}")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("_cons", self.intercept), *((t.name, float(b)) for t, b in zip([*self.numeric, *self.levels], [*self.slopes, *self.steps], strict=True))]
        value = F.col("value")
        shown = F.when(value == NULL_LEVEL, self.missing).when(F.startswith(value, F.lit("\0")), F.substring(value, 2, 2**31 - 1)).otherwise(value)
        away = self.away.where(value != self.base).select(F.concat(F.lit(f"{self.apart}_"), shown).alias("term"), "estimate")
        return small_frame(spark, "term string, estimate double", rows).union(away)


def _value(shown: str) -> str:
    """The level, not the missing one, that is printed as ``shown``."""
    return f"\0{shown}" if shown.startswith("\0") else shown


class _ModelTerms(Sequence):
    """The terms of a model, the numeric ones first; counted without gathering them."""

    def __init__(self, model: LevelModel):
        self.model = model

    def __len__(self) -> int:
        return len(self.model.numeric) + len(self.model.levels) + self.model.size - 1

    def __iter__(self) -> Iterator[Term]:
        yield from self.model.numeric
        yield from self.model.gathered[0]

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        i = i + len(self) if i < 0 else i
        return self.model.numeric[i] if 0 <= i < len(self.model.numeric) else self.model.gathered[0][i - len(self.model.numeric)]


def ols_many_levels(
    df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], tolerance: float = 1e-12, max_iter: int = 2_000
) -> LinearModel:
    """Ordinary least squares by conjugate gradients, scaled by the diagonal; any number of categories.

    The levels of the largest column are given by the other terms; those are solved for on what the levels' means leave of them.
    Under collinearity some solution is returned, with the same predictions as any other.
    """
    with level_system(df, label, numeric, categorical, largest_apart=True) as system:
        scale = np.concatenate([np.diag(system.dense), system.diagonal])
        scale = np.where(scale > 0, scale, 1.0)
        if system.apart:
            scale[0] = np.inf  # the constant is the sum of the levels apart, so it stays at zero
        w = np.zeros(len(scale))
        # Of the whole system, the column apart included.
        start = float(system.right @ (system.right / scale)) + (system.apart.square if system.apart else 0.0)
        residual = system.right - system.explained()
        direction = residual / scale
        size = float(residual @ direction)
        for _ in range(max_iter):
            if size <= tolerance**2 * max(start, 1e-300):
                return LevelModel(system, w, categorical) if system.apart else system.model(w)
            moved = system.times(direction) - system.explained(direction)
            step = size / float(direction @ moved)
            w += step * direction
            residual -= step * moved
            before, size = size, float(residual @ (residual / scale))
            direction = residual / scale + size / before * direction
        raise ArithmeticError(f"no solution within {max_iter} passes")


def lasso_many_levels(
    df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], alpha: float, tolerance: float = 1e-9, max_iter: int = 500
) -> LinearModel:
    """Lasso at one penalty, the objective of ``lasso``: constant and numeric columns one by one, then the dummies of a column at once.

    Ends when no term is off its condition by more than ``tolerance`` of the penalty.
    """
    with level_system(df, label, numeric, categorical) as system:
        k, n = len(system.dense), system.n
        w = np.zeros(k + len(system.levels))
        slope = system.right.copy()  # products of all terms with what is left of the label

        def soft(x, weight):
            return np.sign(x) * np.maximum(np.abs(x) - n * alpha, 0.0) / np.where(weight > 0, weight, 1.0)

        for _ in range(max_iter):
            for _ in range(100):
                largest = 0.0
                for i in range(k):
                    weight = system.dense[i, i]
                    if weight <= 0:
                        continue
                    at = slope[i] + weight * w[i]
                    step = (at / weight if i == 0 else float(soft(at, weight))) - w[i]
                    w[i] += step
                    slope[:k] -= step * system.dense[i]
                    slope[k:] -= step * system.side[:, i]
                    largest = max(largest, abs(step) * weight)
                if largest <= 1e-14 * n * alpha:
                    break
            for block in system.blocks:
                at = k + block
                new = soft(slope[at] + system.diagonal[block] * w[at], system.diagonal[block])
                step = np.zeros(len(system.levels))
                step[block] = new - w[at]
                w[at] = new
                if step.any():
                    slope[:k] -= step @ system.side
                    slope[k:] -= system.diagonal * step + system.pairs_times(step)
            gap = np.where(w != 0, np.abs(slope - n * alpha * np.sign(w)), np.maximum(np.abs(slope) - n * alpha, 0.0))
            gap[0] = abs(slope[0])
            if gap.max(initial=0.0) <= tolerance * n * alpha:
                return system.model(w)
        raise ArithmeticError(f"no solution for penalty {alpha} within {max_iter} rounds")
