"""Repeated byte strings and the byte model against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gramwise.llm import ppm, suffix_dedup
from gramwise.llm.common import text_bytes


def without_repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield len(t), sum(gone), runs, bytes(x for x, g in zip(t, gone, strict=True) if not g)


@pytest.mark.parametrize("bucket_texts", [4096, 1])
@pytest.mark.parametrize("length", [7, 40, 400])
def test_repeats_equal_brute_force(make, prose, length, bucket_texts):
    rng = random.Random(length)
    parts = [x[:450] for x in prose(6, 100, 1)] + ["ab" * 300, "z" * 900, "é" * 250]
    rows = [(i, "".join(rng.choice(parts)[rng.randrange(60) :] + str(rng.random()) for _ in range(rng.randint(0, 4)))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, parts[0]), (102, parts[0]), (102, parts[0]), (None, None)]
    found = suffix_dedup.without_repeats(make(rows), length, None, bucket_texts).collect()
    expected = [(d, *x) for (d, _), x in zip(rows, without_repeats([t for _, t in rows], length), strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found), key=order) == sorted(expected, key=order)


def test_repeats_of_empty_table(make):
    assert suffix_dedup.without_repeats(make([])).collect() == []


def test_refined_buckets_are_equality_of_strings():
    rng = np.random.default_rng(1)
    for length in (1, 5, 8, 13, 100):
        text = rng.integers(97, 99, 2000).astype(np.uint8)
        text[900:1400] = text[100:600]
        numbers = suffix_dedup.refined(text, length)
        strings = [text[i : i + length].tobytes() for i in range(len(text) - length + 1)]
        pairs = set(zip(numbers[: len(strings)].tolist(), strings, strict=True))
        assert len(pairs) == len({n for n, _ in pairs}) == len(set(strings))


def plain_ppm(training, text, order):
    """The same model by its definition, context by context."""
    counts = [Counter() for _ in range(order + 1)]
    for t in training:
        framed = b"\xff" * order + t + b"\xff"
        for i in range(order, len(framed)):
            for k in range(order + 1):
                counts[k][framed[i - k : i + 1]] += 1
    total, framed = 0.0, b"\xff" * order + text + b"\xff"
    for i in range(order, len(framed)):
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            context = framed[i - k : i]
            seen = {g[-1]: n for g, n in counts[k].items() if g[:-1] == context and g[-1] not in excluded}
            if not any(g[:-1] == context for g in counts[k]):
                continue
            size = sum(seen.values())
            if framed[i] in seen:
                total += math.log10((seen[framed[i]] - 0.5) / size)
                break
            if size:
                total += math.log10(0.5 * len(seen) / size)
            excluded |= set(seen)
        else:
            total += -math.log10(256 - len(excluded))
    return total


def test_model_equals_definition():
    training = [b"abracadabra", b"abra kadabra", b"", b"banana bandana"]
    data, offsets = text_bytes(pa.array([t.decode() for t in training]))
    for order in (1, 3, 6):
        keys = ppm.grams(*ppm.framed(data, offsets, order), np.diff(offsets), order)
        entries = {size: np.unique(keys & np.uint64((1 << 8 * size) - 1), return_counts=True) for size in range(1, order + 2)}
        model = ppm.ByteModel.of(entries, order)
        for text in (b"abra", b"", b"banabra xyz", b"\xc3\xa9a"):
            part, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
            logs = model.log10(ppm.grams(*ppm.framed(part, bounds, order), np.diff(bounds), order))
            assert logs.sum() == pytest.approx(plain_ppm(training, text, order), rel=1e-5)


def test_model_chances_sum_to_one():
    rng = np.random.default_rng(2)
    order, text = 4, bytes(rng.choice(list(b"abcd "), 4000).tolist())
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    keys = ppm.grams(*ppm.framed(data, bounds, order), np.diff(bounds), order)
    entries = {size: np.unique(keys & np.uint64((1 << 8 * size) - 1), return_counts=True) for size in range(1, order + 2)}
    # Pruned: rare entries are missing, but never one whose longer form is there.
    entries = {size: (k[c >= 5], c[c >= 5]) if size > 1 else (k, c) for size, (k, c) in entries.items()}
    model = ppm.ByteModel.of(entries, order)
    for context in (b"abcd", b"a bc", b"zzzz", b"zzab", b"\xff\xff\xff\xff"):
        base = int.from_bytes(context, "big") << 8
        logs = model.log10(np.array([base + x for x in range(256)], np.uint64))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)


def test_scores_and_base_scores(spark, make, prose, edge_rows):
    rows = edge_rows[:11] + [(20 + i, t) for i, t in enumerate(prose(30, 200, 9))]
    docs = make(rows)
    training = docs.filter("doc_id is null or doc_id % 5 <> 0").select("text")
    learned = [t for i, t in rows if i is None or i % 5 != 0]
    counts = Counter(w for t in learned for w in (t or "").encode().lower().split())
    counts[None] = len(learned)
    n, v = sum(counts.values()), len(counts)
    for words in (1 << 16, 20):
        found = ppm.score(docs.select("doc_id", "text"), training, order=3, words=words, parts=3).collect()
        assert len(found) == len(rows)
        by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
        for doc_id, text in rows:
            if doc_id is not None:
                row, tokens = by_id[doc_id], [*(text or "").encode().lower().split(), None]
                assert (row["n_tokens"], row["train_tokens"]) == (len(tokens), n)
                assert row["n_known"] == sum(counts[t] > 0 for t in tokens)
                assert row["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
                assert row["score"] < 0
    empty = ppm.score(docs.select("doc_id", "text"), training.limit(0), order=3).collect()
    sizes = {i: len((t or "").encode()) for i, t in rows}
    assert all(r["score"] == pytest.approx(-math.log10(256) * (sizes[r["doc_id"]] + 1), rel=1e-5) for r in empty if r["doc_id"] is not None)
    assert ppm.score(docs.select("doc_id", "text").limit(0), training, order=3).collect() == []


@pytest.mark.parametrize("nodes", [1 << 20, 50])
def test_scores_are_those_of_the_whole_trie(make, prose, edge_rows, nodes):
    rows = [*edge_rows[:9], *enumerate(prose(8, 40, 3), 20), (40, "été ÉTÉ zzz"), (41, "xyzzy")]
    docs = make(rows)
    training = docs.filter("doc_id is null or doc_id % 3 <> 0").select("text")
    learned = [(t or "").encode().lower() for i, t in rows if i is None or i % 3 != 0]
    for order in (1, 6):
        found = ppm.score(docs.select("doc_id", "text"), training, order=order, nodes=nodes, parts=5).collect()
        by_id = {r["doc_id"]: r["score"] for r in found}
        for doc_id, text in rows:
            if doc_id is not None:
                assert by_id[doc_id] == pytest.approx(plain_ppm(learned, (text or "").encode().lower(), order), rel=1e-5)


def test_held_out_split(spark):
    from gramwise.llm.common import is_held_out

    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    found = {r["doc_id"] for r in ids.filter(is_held_out("doc_id", 7, 2)).collect()}
    assert found == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2}


def test_many_equal_rows_cost_what_their_bytes_do(spark, prose):
    """5,000 equal rows of 2,400 bytes, id and text alike, beside others."""
    from pyspark.sql import functions as F

    one, other = prose(2, 500, 77)
    docs = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(one).alias("text"))
    docs = docs.union(spark.createDataFrame([(2, other)], "doc_id bigint, text string"))
    found = suffix_dedup.without_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, found)) == [(1, len(one), len(one), 1, 5000), (2, len(other), 0, 0, 1)]
