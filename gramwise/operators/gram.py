"""The cross-product (Gram) matrix of a regression, by group, from one pass over the rows.

Every linear model here is fitted from sums of products, so only a p x p matrix per group leaves the cluster:

* Numeric columns only: one aggregate of counts, means and covariances.  Spark's own covariance aggregate
  merges partial results without cancellation, so no pass for centring is needed.
* With categorical columns: the cross products of indicators are contingency tables of pairs of categories, which every task
  counts in one pass.  The indicator columns are never built, nor cells of all categories at once.
* Many numeric columns, or columns derived from a few: a matrix product per Arrow batch, summed by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramwise.functions.columns import in_level_order, level, level_names
from gramwise.operators.cache import kept
from gramwise.operators.prepare import complete_cases

MAX_ENTRIES = 10_000_000  # numbers the driver may gather: groups * p * p
WIDE = 16  # numeric columns from which the batch product beats one aggregate per pair


@dataclass(frozen=True, order=True)
class Term:
    """A numeric column, or the indicator of one category of a column."""

    column: str
    value: str | None = None
    shown: str | None = field(default=None, compare=False)

    @property
    def name(self) -> str:
        return self.column if self.value is None else f"{self.column}_{self.shown or self.value}"


def category_terms(column: str, values: Sequence[str]) -> list[Term]:
    names = level_names(values)
    return [Term(column, v, names[v]) for v in values]


@dataclass(frozen=True)
class Moments:
    """Count, means and centred cross products of a list of terms."""

    terms: tuple[Term, ...]
    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def at(self, terms: Sequence[Term]) -> tuple[np.ndarray, np.ndarray]:
        index = [self.terms.index(t) for t in terms]
        return self.mean[index], self.scatter[np.ix_(index, index)]

    def raw(self, terms: Sequence[Term]) -> np.ndarray:
        """Cross products about zero, for models through the origin."""
        mean, scatter = self.at(terms)
        return scatter + self.n * np.outer(mean, mean)


@dataclass(frozen=True)
class GramTable:
    """One additive moment matrix per group; all share the same shift, so groups can be summed."""

    terms: tuple[Term, ...]
    shift: np.ndarray
    groups: dict[int, np.ndarray]

    def moments(self, groups: Iterable[int] | None = None) -> Moments:
        chosen = list(self.groups) if groups is None else [g for g in groups if g in self.groups]
        if not chosen:
            raise ValueError("no rows to fit")
        total = sum(self.groups[g] for g in chosen)
        n, first = total[0, 0], total[0, 1:]
        return Moments(self.terms, n, self.shift + first / n, total[1:, 1:] - np.outer(first, first) / n)

    def levels(self, column: str, groups: Iterable[int] | None = None) -> list[str]:
        """Categories that occur in the groups, sorted; missing values form a category that comes last."""
        chosen = list(self.groups) if groups is None else [g for g in groups if g in self.groups]
        total = sum(self.groups[g] for g in chosen)
        found = [t.value for i, t in enumerate(self.terms, 1) if t.column == column and total[i, i] > 0]
        return in_level_order(found)

    def dummies(self, columns: Sequence[str], groups: Iterable[int] | None = None) -> list[Term]:
        """Indicators of every category but the first, by column."""
        known = {(t.column, t.value): t for t in self.terms}
        return [known[c, v] for c in columns for v in self.levels(c, groups)[1:]]


def gram_table(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    group: Column | None = None,
    most: int = MAX_ENTRIES,
) -> GramTable:
    """Moment matrices by group (folds, for instance).  Rows with a missing numeric value are left out.

    Beyond ``most`` numbers in all matrices, which the driver holds, it refuses; see ``operators.iterative``.
    """
    group = F.lit(0) if group is None else group
    rows = df.select(
        group.cast("int").alias("__group"),
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[level(F.col(c)).alias(c) for c in categorical],
    )
    rows = complete_cases(rows, numeric)
    if categorical:
        return _with_categories(rows, list(numeric), list(categorical), most)
    if len(numeric) >= WIDE:
        return _wide(rows, list(numeric), most)
    return _numeric_only(rows, list(numeric), most)


def _cell_aggregates(numeric: Sequence[str]) -> list[Column]:
    pairs = list(combinations_with_replacement(range(len(numeric)), 2))
    return [
        F.count("*").cast("double").alias("__n"),
        *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(numeric)],
        *[F.covar_pop(numeric[i], numeric[j]).alias(f"__c{i}_{j}") for i, j in pairs],
    ]


def _check_size(groups: int, terms: int, most: int) -> None:
    if groups * terms * terms > most:
        raise ValueError(f"{groups} groups of {terms} terms are too many for a dense cross-product matrix")


def _shifted(n: float, mean: np.ndarray, cov: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Moment matrix of (1, x - shift) for a cell with known count, means and covariances."""
    d = mean - shift
    p = len(mean)
    out = np.empty((p + 1, p + 1))
    out[0, 0] = n
    out[0, 1:] = out[1:, 0] = n * d
    out[1:, 1:] = n * (cov + np.outer(d, d))
    return out


def _numeric_only(rows: DataFrame, numeric: list[str], most: int) -> GramTable:
    p = len(numeric)
    limit = most // (p * p)
    found = rows.groupBy("__group").agg(*_cell_aggregates(numeric)).limit(limit + 1).collect()
    _check_size(len(found), p, most)
    if not found:
        raise ValueError("no complete rows")
    cells = {}
    for row in found:
        mean = np.array([row[f"__m{i}"] for i in range(p)])
        cov = np.empty((p, p))
        for i, j in combinations_with_replacement(range(p), 2):
            cov[i, j] = cov[j, i] = row[f"__c{i}_{j}"]
        cells[row["__group"]] = (row["__n"], mean, cov)
    total = sum(n for n, _, _ in cells.values())
    shift = sum(n * mean for n, mean, _ in cells.values()) / total
    groups = {g: _shifted(*cells[g], shift) for g in sorted(cells)}
    return GramTable(tuple(Term(c) for c in numeric), shift, groups)


def _wide(rows: DataFrame, numeric: list[str], most: int) -> GramTable:
    first = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(numeric)]).first()
    if not first["n"]:
        raise ValueError("no complete rows")
    shift = np.array([first[f"__m{i}"] for i in range(len(numeric))])
    return batch_gram(rows, numeric, numeric, lambda x: x, shift, most)


def batch_gram(
    rows: DataFrame,
    columns: Sequence[str],
    names: Sequence[str],
    derive: Callable[[np.ndarray], np.ndarray],
    shift: np.ndarray,
    most: int = MAX_ENTRIES,
) -> GramTable:
    """Moment matrices of ``derive(columns)``, a row-wise numpy function giving one column per name.

    Only the source columns travel to Python.  ``rows`` has a ``__group`` column and no missing values; each
    task returns one matrix per group.  ``shift`` should be near the means of the derived columns.
    """
    width = len(names) + 1

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(0).to_numpy()
            x = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(columns))])
            z = np.column_stack([np.ones(len(keys)), derive(x) - shift])
            for key in np.unique(keys):
                part = z[keys == key]
                sums[int(key)] = sums.get(int(key), 0.0) + part.T @ part
        for key, value in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"__group": pa.array([key], pa.int32()), "sums": pa.array([value.ravel()], pa.list_(pa.float64()))}
            )

    limit = most // width**2
    found = (
        rows.select("__group", *columns)
        .mapInArrow(partial, "__group int, sums array<double>")
        .select("__group", F.posexplode("sums"))
        .groupBy("__group", "pos")
        .agg(F.sum("col").alias("v"))
        .limit((limit + 1) * width**2)
        .collect()
    )
    if not found:
        raise ValueError("no complete rows")
    groups: dict[int, np.ndarray] = {}
    for row in found:
        groups.setdefault(row["__group"], np.zeros(width**2))[row["pos"]] = row["v"]
    _check_size(len(groups), width, most)
    return GramTable(
        tuple(Term(c) for c in names), shift, {g: groups[g].reshape(width, width) for g in sorted(groups)}
    )


class _Margin:
    """Sums by an integer key, merged whenever the unmerged part has grown as large as the merged one."""

    def __init__(self):
        self.keys, self.sums, self._more, self._size = np.zeros(0, np.int64), None, [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        found, at = np.unique(keys, return_inverse=True)
        sums = np.column_stack([np.bincount(at, v, len(found)) for v in values.T])
        self._more.append((found, sums))
        self._size += len(found)
        if self._size > max(len(self.keys), 100_000):
            self.merge()

    def merge(self) -> None:
        parts = self._more if self.sums is None else [(self.keys, self.sums), *self._more]
        self._more, self._size = [], 0
        if parts:
            self.keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            every = np.concatenate([v for _, v in parts])
            self.sums = np.column_stack([np.bincount(at, v, len(self.keys)) for v in every.T])


#: Codes of levels and groups that a task may use before it sends what it has and starts anew; three of them fit into a key.
_MOST_CODES = 1 << 20
#: Sums that a task holds at most, about.
_MOST_SUMS = 2_000_000


def pair_sums(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Counts, means and covariances of each task's rows by group, by group and level, and counts by group and pair of levels.

    ``kind`` is 0 for a whole group, then counts the columns, then their pairs; ``a`` and ``b`` are levels.  A task sends one row for
    each level and each pair of levels that it has seen, never one for each combination of all columns.
    """
    p, c = len(numeric), len(categorical)
    squares = list(combinations_with_replacement(range(p), 2))
    pairs = list(combinations(range(c), 2))
    names = ["__group", "kind", "a", "b", "__n", *[f"__m{i}" for i in range(p)], *[f"__c{i}_{j}" for i, j in squares]]
    kinds = ["int", "int", "string", "string", *["double"] * (len(names) - 4)]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        shift = None
        codes: list[dict] = [{} for _ in range(c + 1)]
        margins = [_Margin() for _ in range(1 + c + len(pairs))]

        def number(column: int, values: pa.Array) -> np.ndarray:
            coded = values.dictionary_encode()
            known = codes[column]
            here = np.array([known.setdefault(v, len(known)) for v in coded.dictionary.to_pylist()], np.int64)
            return here[coded.indices.to_numpy()]

        def sent() -> Iterable[pa.RecordBatch]:
            levels = [list(x) for x in codes]
            for kind, margin in enumerate(margins):
                margin.merge()
                if margin.sums is None:
                    continue
                group, first, second = margin.keys & (_MOST_CODES - 1), margin.keys >> 20 & (_MOST_CODES - 1), margin.keys >> 40
                left, right = (kind, 0) if kind <= c else (pairs[kind - c - 1][0] + 1, pairs[kind - c - 1][1] + 1)
                n, size = margin.sums[:, 0], len(margin.keys)
                out = {
                    "__group": pa.array([levels[0][g] for g in group.tolist()], pa.int32()),
                    "kind": pa.array(np.full(size, kind, np.int32)),
                    "a": pa.array([levels[left][x] for x in first.tolist()] if kind else [None] * size, pa.string()),
                    "b": pa.array([levels[right][x] for x in second.tolist()] if kind > c else [None] * size, pa.string()),
                    "__n": n,
                }
                means = [margin.sums[:, 1 + i] / n for i in range(p)] if kind <= c else None
                for i in range(p):
                    out[f"__m{i}"] = means[i] + shift[i] if means else pa.nulls(size, pa.float64())
                for k, (i, j) in enumerate(squares):
                    out[f"__c{i}_{j}"] = margin.sums[:, 1 + p + k] / n - means[i] * means[j] if not kind else pa.nulls(size, pa.float64())
                yield pa.RecordBatch.from_pydict(out)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(n).to_numpy() for n in numeric]) if p else np.zeros((batch.num_rows, 0))
            # Sums about a point among the values keep their digits.
            shift = x.mean(0) if shift is None else shift
            x = x - shift
            group = number(0, batch.column("__group"))
            level_ = [number(i + 1, batch.column(n)) << 20 for i, n in enumerate(categorical)]
            one = np.ones((len(x), 1))
            margins[0].add(group, np.column_stack([one, x, *[x[:, i] * x[:, j] for i, j in squares]]))
            for i in range(c):
                margins[1 + i].add(group | level_[i], np.column_stack([one, x]))
            for k, (i, j) in enumerate(pairs):
                margins[1 + c + k].add(group | level_[i] | level_[j] << 20, one)
            if max(map(len, codes)) > _MOST_CODES - 100_000 or sum(len(m.keys) for m in margins) > _MOST_SUMS:
                yield from sent()
                codes, margins = [{} for _ in range(c + 1)], [_Margin() for _ in margins]
        yield from sent()

    return rows.mapInArrow(add, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def _with_categories(rows: DataFrame, numeric: list[str], categorical: list[str], most: int) -> GramTable:
    p, kinds = len(numeric), len(categorical)
    with kept(pair_sums(rows, numeric, categorical)) as parts:
        whole = F.when(F.col("kind") == 0, F.col("__n"))
        level_of = [F.when(F.col("kind") == i + 1, F.col("a")) for i in range(kinds)]
        head = parts.agg(
            F.sum(whole).alias("n"),
            *[(F.sum(whole * F.col(f"__m{i}")) / F.sum(whole)).alias(f"s{i}") for i in range(p)],
            F.count_distinct("__group").alias("k"),
            *[F.count_distinct(x).alias(f"k{i}") for i, x in enumerate(level_of)],
        ).first()
        if not head["n"]:
            raise ValueError("no complete rows")
        shift = [head[f"s{i}"] for i in range(p)]
        _check_size(head["k"], p + sum(head[f"k{i}"] for i in range(kinds)), most)

        n = F.col("__n")
        d = [F.col(f"__m{i}") - F.lit(shift[i]) for i in range(p)]
        sums = [F.sum(n).alias("n"), *[F.sum(n * d[i]).alias(f"f{i}") for i in range(p)]]
        sums += [
            F.sum(n * (F.col(f"__c{i}_{j}") + d[i] * d[j])).alias(f"s{i}_{j}")
            for i, j in combinations_with_replacement(range(p), 2)
        ]
        margins = parts.groupBy("__group", "kind", "a", "b").agg(*sums).toArrow().to_pandas()

    # One column of levels for each category, empty where a sum is not about it.
    kind = margins["kind"].to_numpy()
    pairs = list(combinations(range(kinds), 2))
    for i, c in enumerate(categorical):
        left = np.isin(kind, [i + 1, *(kinds + 1 + k for k, pair in enumerate(pairs) if pair[0] == i)])
        right = np.isin(kind, [kinds + 1 + k for k, pair in enumerate(pairs) if pair[1] == i])
        margins[f"__level_{c}"] = np.where(left, margins["a"], np.where(right, margins["b"], None))
    margins = margins.drop(columns=["kind", "a", "b"]).rename(columns={f"__level_{c}": c for c in categorical})

    present = {c: margins[c].notna() for c in categorical}
    found = {c: sorted(margins.loc[present[c], c].unique()) for c in categorical}
    terms = [Term(c) for c in numeric] + [t for c in categorical for t in category_terms(c, found[c])]
    position = {t: i for i, t in enumerate(terms, 1)}
    groups = sorted(int(g) for g in margins["__group"].unique())
    slot = margins["__group"].map({g: i for i, g in enumerate(groups)}).to_numpy()
    column = {c: margins[c].map({v: position[Term(c, v)] for v in found[c]}).fillna(0).to_numpy(int) for c in categorical}
    depth = sum(mask.to_numpy(int) for mask in present.values())
    m = np.zeros((len(groups), len(terms) + 1, len(terms) + 1))

    def put(rows: np.ndarray, a, b, values: str) -> None:
        g, v = slot[rows], margins[values].to_numpy()[rows]
        m[g, a, b] = v
        m[g, b, a] = v

    whole = np.flatnonzero(depth == 0)
    put(whole, 0, 0, "n")
    for i in range(p):
        put(whole, 0, i + 1, f"f{i}")
    for i, j in combinations_with_replacement(range(p), 2):
        put(whole, i + 1, j + 1, f"s{i}_{j}")
    for c in categorical:
        rows = np.flatnonzero((depth == 1) & present[c].to_numpy())
        at = column[c][rows]
        put(rows, 0, at, "n")
        put(rows, at, at, "n")
        for i in range(p):
            put(rows, i + 1, at, f"f{i}")
    for c, other in combinations(categorical, 2):
        rows = np.flatnonzero((depth == 2) & present[c].to_numpy() & present[other].to_numpy())
        put(rows, column[c][rows], column[other][rows], "n")
    full_shift = np.concatenate([shift, np.zeros(len(terms) - p)])
    return GramTable(tuple(terms), full_shift, dict(zip(groups, m, strict=True)))
