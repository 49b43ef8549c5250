"""Hard negatives against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramwise.llm import negatives
from gramwise.llm.negatives import Codes


def _expected(rows, is_anchor):
    """All windows by sorting all scores."""
    out = []
    for k, (i, label, x) in enumerate(rows):
        if not is_anchor(i):
            continue
        scores = [(-sum(a * b for a, b in zip(x, y, strict=False)), j, m) for n, (j, m, y) in enumerate(rows) if n != k]
        scores.sort()
        for s, j, m in [s for s in scores if s[2] == label][:5]:
            p = -s
            near = [(-t, n) for t, n, other in scores if other != label and 80 * p <= -100 * t <= 100 * p][:5]
            out += [(i, j, rank, n, p, t) for rank, (t, n) in enumerate(near, 1)]
    return sorted(out)


def _table(spark, rows):
    return spark.createDataFrame([(i, m, [int(v) for v in x]) for i, m, x in rows], "id bigint, label bigint, vector array<bigint>")


def _got(spark, rows, is_anchor, **options):
    table = _table(spark, rows)
    ids = [i for i, _, _ in rows if is_anchor(i)]
    return sorted(map(tuple, negatives.hard_negatives(table, table.filter(F.col("id").isin(ids)), **options).collect()))


def _clusters(n, dim=6, groups=5, seed=0, spread=20):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-300, 300, (groups, dim))
    return [(i, int(rng.integers(0, 3)), (centres[i % groups] + rng.integers(-spread, spread, dim)).tolist()) for i in range(n)]


def test_windows_equal_sorting(spark):
    rows = _clusters(400)
    assert _got(spark, rows, lambda i: i % 20 == 0) == _expected(rows, lambda i: i % 20 == 0)


def test_rounds_and_blocks(spark, monkeypatch):
    """Several rounds, several blocks to a cell, and floors from the rounds before."""
    monkeypatch.setattr(negatives, "FIRST_VISIT", 20)
    monkeypatch.setattr(negatives, "GROWTH", 3)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = _clusters(300, seed=2)
    assert _got(spark, rows, lambda i: i % 15 == 0, codes=6) == _expected(rows, lambda i: i % 15 == 0)


def test_ties_copies_and_short_vectors(spark):
    """A third of all rows are one vector; ids and whole rows repeat; vectors differ in length."""
    rows = [(i, 1, [5, 5, 5, 5]) for i in range(40)] + [(i, i % 3, [5, 5, 5, i % 4]) for i in range(40, 80)]
    rows += [(100, 1, [5, 5, 5, 5])] * 3 + [(100, 2, [5, 5]), (7, 2, []), (8, 0, [5, 5, 5, 5, 1])]
    expected = _expected(rows, lambda i: i in (0, 50, 100))
    assert _got(spark, rows, lambda i: i in (0, 50, 100)) == expected and expected


def test_few_rows_and_none(spark):
    assert _got(spark, [], lambda i: True) == []
    assert _got(spark, [(0, 1, [1, 2])], lambda i: True) == []
    rows = [(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [3, 3]), (3, 2, [-3, -3])]
    assert _got(spark, rows, lambda i: i == 0) == [(0, 1, 1, 2, 25, 21)]


def test_large_numbers_are_exact(spark):
    rows = [(i, i % 2, [2**28 + 3 * i, 2**27 - i, 7 * i, i]) for i in range(60)]
    assert _got(spark, rows, lambda i: i == 30) == _expected(rows, lambda i: i == 30)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 2, [0.5, -0.001]), (2, None, [1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [nan]), (6, 1, [-inf]), (None, 1, [1.0]), (7, 0, []), (8, 1, [3e38])]
    df = spark.createDataFrame(data, "vec_id bigint, label int, embedding array<float>").withColumn("slot", F.lit(1))
    got = negatives.prepared(df, F.col("vec_id"), F.col("label"), F.col("embedding")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, [128, -1]), (7, 0, []), (8, 1, [negatives.LARGEST])]


@pytest.mark.parametrize("seed", range(3))
def test_cells_come_in_falling_order_and_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-100, 100, (500, 8))
    books = tuple(negatives.fit_codebook(h, 7) for h in (x[:, :4], x[:, 4:]))
    codes = [negatives._nearest(h, b) for h, b in zip((x[:, :4], x[:, 4:]), books, strict=True)]
    radii = tuple(np.array([max(np.linalg.norm(h[c == k] - b[k], axis=1), default=0) for k in range(7)]) for h, b, c in zip((x[:, :4], x[:, 4:]), books, codes, strict=True))
    counts = np.zeros((7, 7), np.int64)
    np.add.at(counts, tuple(codes), 1)
    index = Codes(books, radii, counts)
    anchor = x[:1]
    first, second = (b[0] for b in index.bounds(anchor))
    scores = (x @ anchor.T)[:, 0]
    assert (scores <= first[codes[0]] + second[codes[1]]).all()
    cells = index.visits(first, second, 0, 10**9, -np.inf)
    order = [first[c // 7] + second[c % 7] for c in cells]
    assert order == sorted(order, reverse=True) and len(cells) == (counts > 0).sum()
    # Rounds follow each other without a gap, and the floor ends a visit.
    assert index.visits(first, second, 0, 100, -np.inf) + index.visits(first, second, 100, 10**9, -np.inf) == cells
    assert index.visits(first, second, 0, 10**9, order[5]) == cells[: sum(o >= order[5] for o in order)]


def test_clustered_vectors_stop_early():
    """On vectors in tight groups a certified window needs a small part of the cells."""
    rows = _clusters(2000, dim=8, groups=20, seed=4, spread=5)
    x = np.array([r[2] for r in rows])
    books = tuple(negatives.fit_codebook(h, 16) for h in (x[:, :4], x[:, 4:]))
    codes = [negatives._nearest(h, b) for h, b in zip((x[:, :4], x[:, 4:]), books, strict=True)]
    radii = tuple(np.array([max(np.linalg.norm(h[c == k] - b[k], axis=1), default=0) for k in range(len(b))]) for h, b, c in zip((x[:, :4], x[:, 4:]), books, codes, strict=True))
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    np.add.at(counts, tuple(codes), 1)
    index = Codes(books, radii, counts)
    fifth = np.sort(x @ x[0])[-6]
    first, second = (b[0] for b in index.bounds(x[:1]))
    seen = sum(counts.ravel()[c] for c in index.visits(first, second, 0, 10**9, fifth))
    assert seen < 0.5 * len(x)
