"""Packing against the tokenizer itself, and the plan of patterns."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gramwise.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_cached_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    plain, cached, rng = Tokenizer.from_file(PATH), packing.CachedTokenizer(PATH, entries=50), random.Random(3)
    letters = "abC'sSTrevVm dDlL019²½ªº×÷_-–!.,\n\t\x1cÀßéÉŒſƂǅǆΣ́ "
    fixed = ["a<|endoftext|>b c", "don't 's x'll", "é é x", "a b c", "İstanbul", "ΑΣ ΟΔΥΣΣΕΥΣ", "a\x00b‍　x", "漢字 kana", "", "😀 ok"]
    for text in fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)]:
        assert cached(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize(("length", "unit"), [(64, 8), (2048, 8), (16, 1)])
def test_pieces_cover_every_id_once(make, edge_rows, prose, length, unit):
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(prose(40, 70, 2))]
    found = packing.pack(make(rows), PATH, length, unit).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(_ids(t) + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        wanted = sorted(
            (at, min(length, len(ids) - at), zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids))
            for ids in texts[i] for at in range(0, len(ids), length)
        )
        assert sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == wanted
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length


def test_empty_table(make):
    assert packing.pack(make([]), PATH).collect() == []


def _bound(size, demand, capacity):
    """No packing needs fewer: large pieces stand apart, and those of medium size must go beside them or among themselves."""
    best = 0
    for k in range(capacity // 2 + 1):
        apart, large = size > capacity - k, (size > capacity // 2) & (size <= capacity - k)
        medium = (size >= k) & (size <= capacity // 2)
        room = int((demand * (capacity - size))[large].sum())
        rest = max(0, int((demand * size)[medium].sum()) - room)
        best = max(best, int(demand[apart | large].sum()) + -(-rest // capacity))
    return best


def test_plan_meets_demand_near_the_bound():
    rng = np.random.default_rng(1)
    size = np.arange(1, 65)
    for demand in (rng.integers(0, 400, 64) + 1, np.full(64, 1), np.where(size == 33, 5000, 1)):
        plan = packing.cutting_plan(size, demand, 64)
        assert all(pattern @ size <= 64 for pattern, _ in plan)
        assert (sum(pattern * times for pattern, times in plan) == demand).all()
        assert sum(times for _, times in plan) <= _bound(size, demand, 64) * 1.02 + 3


def test_pricing_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        size, worth = rng.integers(1, 8, 4), rng.random(4)
        best, stack = 0.0, [(10, 0, 0.0)]
        while stack:
            room, first, value = stack.pop()
            best = max(best, value)
            stack += [(room - size[k], k, value + worth[k]) for k in range(first, 4) if size[k] <= room]
        value, pattern = packing._price(worth, size, 10)
        assert value == pytest.approx(best) and pattern @ worth == pytest.approx(best) and pattern @ size <= 10
