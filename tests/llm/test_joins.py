"""Near-duplicate joins against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramwise.llm import graph, minhash, ngram_join
from gramwise.llm.graph import components


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows):
    """(doc_id, shingles, smallest reachable id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return out


def edits(text, share, rng):
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def key(row):
    return tuple((x is None, x) for x in row)


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (102, 100)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


def test_components_by_rounds_alone(spark, monkeypatch):
    """A chain in order, one in disorder, a star and a ring, without a last task that follows what is left."""
    monkeypatch.setattr(graph, "FEW_LINKS", 0, raising=False)
    order = random.Random(3).sample(range(1000, 1060), 60)
    links = [(i, i + 1) for i in range(50)] + list(zip(order, order[1:], strict=False)) + [(2000, 2000 + i) for i in range(1, 30)]
    links += [(3000 + i, 3000 + (i + 1) % 7) for i in range(7)] + [(-5, -6), (-6, -5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    low = lambda x: -6 if x < 0 else x // 1000 * 1000
    assert found == {x: low(x) for link in links for x in link}


def test_few_links_take_few_tables(spark, monkeypatch):
    """Tables that are written for a long chain of few links: not two and one for each round."""
    write, names = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or write(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    assert components(links).agg({"component": "max"}).first()[0] == 0
    assert len(names) <= 3


def test_jaccard_join_equals_brute_force(make, prose, edge_rows):
    rng = random.Random(3)
    rows = list(edge_rows)
    passage = " ".join(prose(1, 60, 11))
    for k, text in enumerate(prose(12, 90, 12)):
        # Families of near copies on both sides of the threshold, chains of small changes, a passage that all share.
        rows.append((100 + 20 * k, text + " " + passage))
        current = text
        for i in range(1, 8):
            current = edits(current if k % 2 else text, 0.01 + 0.01 * (i % 3), rng)
            rows.append((100 + 20 * k + i, current + " " + passage))
    rng.shuffle(rows)
    found = ngram_join.link_components(make(rows)).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows), key=key)


def test_large_components_are_joined_by_few_pairs(make, prose, monkeypatch):
    """Two halves of a group of near copies that the stars leave apart: not each pair between them is compared."""
    monkeypatch.setattr(ngram_join, "DRAWN_FROM", 10, raising=False)
    stars, verified, compared = ngram_join._stars, ngram_join._verified, []

    def counted(pairs, *more):
        compared.append(pairs.select("a", "b").count())
        return verified(pairs, *more)

    monkeypatch.setattr(ngram_join, "_stars", lambda *x: stars(*x).filter("a % 2 = 0 and b % 2 = 0 or a % 2 <> 0 and b % 2 <> 0"))
    monkeypatch.setattr(ngram_join, "_verified", counted)
    rng = random.Random(5)
    base = prose(1, 400, 51)[0]
    rows = [(i, edits(base, 0.005, rng)) for i in range(60)] + [(100 + i, text) for i, text in enumerate(prose(5, 90, 52))]
    found = ngram_join.link_components(make(rows)).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows), key=key)
    assert sum(compared[1:]) < 100


def test_each_part_has_a_task_of_its_own(make, prose, monkeypatch):
    """What a task gathers is one part, not several that hash to the same place."""

    def parts_met(settle):
        def count(batches):
            met = {x for batch in batches for x in batch.column("part").to_pylist()}
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([len(met)], pa.int32())} | {c: pa.array([b""]) for c in ("classes", "sizes", "counts", "tokens", "often")})

        return count

    monkeypatch.setattr(ngram_join, "_gathered", parts_met)
    docs = make(list(enumerate(prose(20, 60, 61)))).select("doc_id", "text")
    met = [r["bucket"] for r in ngram_join._shared(ngram_join._dealt(docs, 5, 12), 12).collect()]
    assert sum(met) == 12 and max(met) == 1


def test_common_shingles_and_many_parts(make, prose, monkeypatch):
    """Shingles that most documents have go another way; parts and gatherings are small; one class heads a large group."""
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    monkeypatch.setattr(ngram_join, "PART_SHINGLES", 500)
    monkeypatch.setattr(ngram_join, "_GATHERED", 1500)
    rng = random.Random(8)
    base, passage = prose(1, 60, 41)[0], prose(1, 25, 42)[0]
    rows = [(i, edits(base, 0.02, rng) + " " + passage) for i in range(40)]
    rows += [(100 + i, text + " " + passage) for i, text in enumerate(prose(30, 40, 43))]
    rows += [(200 + i, " ".join(passage.split()[: 10 + i % 4])) for i in range(12)]
    found = ngram_join.link_components(make(rows)).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows), key=key)


def test_a_part_writes_a_row_for_each_bucket_not_for_each_class(make, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKETS", 4)
    docs = make([(2 * i + k, text) for i, text in enumerate(prose(60, 80, 44)) for k, text in enumerate((text, text + " end"))])
    lists = ngram_join._shared(ngram_join._dealt(docs, 5, 6), 6)
    assert 0 < lists.count() <= 6 * 4


def test_a_common_shingle_counts_alike_for_all_classes(make, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    monkeypatch.setattr(ngram_join, "_GATHERED", 300)
    passage = prose(1, 30, 45)[0]
    # The last gathering has the passage too seldom to send it apart.
    docs = make([(i, f"{text} {passage}") for i, text in enumerate(prose(22, 40, 46))]).coalesce(1)
    often = {}
    for row in ngram_join._shared(ngram_join._dealt(docs, 5, 2), 2).collect():
        for token, count in zip(np.frombuffer(row["tokens"], "<u8").tolist(), np.frombuffer(row["often"], "<i4").tolist(), strict=True):
            often.setdefault(token, set()).add(count)
    assert often and all(len(x) == 1 for x in often.values())


def test_a_class_leads_only_classes_of_linkable_size(spark):
    postings = spark.createDataFrame([(1, 50, 9, 100), (2, 81, 9, 100), (3, 126, 9, 100), (4, 125, 9, 100)], "class bigint, n int, lead bigint, lead_n int")
    assert sorted(map(tuple, ngram_join._stars(postings, 0, 80, 100).collect())) == [(2, 9), (4, 9)]


def test_jaccard_join_of_empty_table(make):
    assert ngram_join.link_components(make([])).collect() == []


def test_jaccard_threshold_is_inclusive(make):
    words = [f"w{i}" for i in range(200)]
    # 40 common shingles of 50 in the union: exactly 0.8.
    a, b = words[:49], words[5:44] + ["x"] * 0 + words[44:54]
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    x, y = shingles(rows[0][1]), shingles(rows[1][1])
    assert (len(x & y), len(x | y)) == (40, 50)
    assert [r["component_id"] for r in ngram_join.link_components(make(rows)).orderBy("doc_id").collect()] == [1, 1]


def test_fingerprints_and_edited_texts(make, edge_rows):
    import hashlib

    rows = edge_rows
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for per_range in (3, 1000):
        found = minhash.fingerprints(make(rows), rows=per_range).collect()
        assert len(found) == len(rows)
        expected = []
        for i, (doc_id, text) in enumerate(order):
            text, following = text or "", order[(i + 1) % len(order)][1] or ""
            cut = len(text) // 3
            changed = text[: len(text) - cut] + following[:cut]
            expected.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest()))
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=key) == sorted(expected, key=key)
        by_text = {r["doc_id"]: r["fingerprint"] for r in found}
        assert by_text[1] == by_text[2] and by_text[7] == by_text[8] and by_text[4] == by_text[5] == by_text[6]
        assert by_text[1] != by_text[3]
    assert minhash.fingerprints(make([])).collect() == []


def test_likeness_estimates_similarity(prose):
    texts = prose(30, 300, 21)
    rng = random.Random(1)
    for text in texts:
        other = edits(text, 0.03, rng)
        x, y = shingles(text), shingles(other)
        a, b = minhash.signatures([text.encode(), other.encode()], 256)
        assert minhash.likeness(a, b) == pytest.approx(len(x & y) / len(x | y), abs=0.12)


def test_near_classes_by_bands(make, prose):
    rng = random.Random(2)
    texts = prose(6, 200, 31)
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, t) for i, t in enumerate(texts)]
    rows += [(100 + 10 * i + k, edits(t, 0.01, rng)) for i, t in enumerate(texts) for k in range(4)] + [(50, None), (51, "")]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_classes(make(rows)).collect()}
    assert all(found[10 + i] == i for i in range(6))
    exact = {d: c for d, _, c in brute(rows)}
    agree = sum(found[d] == c for d, c in exact.items())
    assert agree >= 0.95 * len(exact)
    assert found[50] == 50 and found[51] == 51
    assert minhash.near_pairs(make(rows)).filter(F.col("jaccard") < 0.8).count() == 0


def test_equal_fingerprints_of_different_sets_are_verified(make):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(8)]
    rows = [(i, " ".join(rng.sample(vocabulary, 4))) for i in range(40)]
    docs = make(rows)
    # One least value as fingerprint: many different sets share it, and only equal ones are alike enough.
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_classes(docs, 0.8, 1, 1, 1).collect()}
    smallest = {}
    for i, text in rows:
        smallest.setdefault(frozenset(text.split()), i)
    assert found == {i: smallest[frozenset(text.split())] for i, text in rows}
