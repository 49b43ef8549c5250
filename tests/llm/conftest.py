from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from ``(doc_id, text)`` rows, with columns whose names the operators use inside as well."""

    def build(rows, lang=None, extra=True):
        data = [(i, t, lang and lang.get(i), "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, SCHEMA)
        names = ("key", "class", "component", "start", "kind", "spans", "clean", "row", "rank", "bucket", "score", "base", "n")
        return df.selectExpr("*", *(f"cast(null as string) as {x}" for x in names if x not in df.columns)) if extra else df

    return build


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words: ``prose(n, words, seed)``."""

    def write(n, words, seed=0, syllables=("ka", "lo", "mi", "re", "su", "tan", "vel", "or")):
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]
        return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]

    return write


@pytest.fixture(scope="session")
def edge_rows(prose):
    """Nulls, empty and blank texts, one very long text, ties and repeated rows."""
    a, b, c = prose(3, 120, 5)
    long = " ".join(prose(1, 30_000, 6))
    return [(1, a), (2, a), (2, a), (3, b), (None, c), (None, None), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  TWO"), (9, long), (10, c)]
