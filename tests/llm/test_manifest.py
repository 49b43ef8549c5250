"""Exact copies and Merkle proofs against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gramwise.llm import exact_dedup, merkle
from gramwise.llm.common import written


def _normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _groups(rows):
    """What ``exact_groups`` should return, sorted."""
    members = defaultdict(list)
    for i, text in rows:
        members[_normal(text)].append(i)
    out = []
    for text, ids in members.items():
        ids.sort(key=lambda i: (i is None, i))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def test_exact_groups_equal_plain_python(make, edge_rows):
    rows = [*edge_rows, (20, "a\x0bb"), (21, "a b"), (22, "a b"), (23, " a b"), (24, "é b"), (25, "e b"), (None, "a b")]
    same_start = "x" * exact_dedup.PREFIX_CHARS
    rows += [(30, same_start + "1"), (31, same_start + "2"), (32, same_start + "2")]
    got = exact_dedup.exact_groups(make(rows), digest_all=True)
    assert sorted(map(tuple, got.collect()), key=str) == _groups(rows)


def test_content_of_lone_prefixes_is_not_hashed(make):
    rows = [(1, "abc"), (2, "abd"), (3, "abc"), (4, "longer")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(make(rows)).collect()}
    assert got[4]["text_sha256"] is None and got[2]["text_sha256"] is None
    assert got[3]["keep_id"] == 1 and got[1]["text_sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_hot_group_and_empty_table(spark, make):
    rows = [(i, "the same  text" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup.exact_groups(make(rows), digest_all=True)
    assert sorted(map(tuple, got.collect()), key=str) == _groups(rows)
    assert exact_dedup.exact_groups(make([])).collect() == []


def test_full_bit_set_loses_nothing(make, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_SLICES", 1)
    rows = [(i, f"text {i % 4000}") for i in range(6000)]
    got = exact_dedup.exact_groups(make(rows), digest_all=True)
    assert sorted(map(tuple, got.collect()), key=str) == _groups(rows)


def test_without_copies_keeps_one_row_of_each_text(make, edge_rows):
    kept = exact_dedup.without_copies(make(edge_rows)).collect()
    assert sorted(_normal(r["text"]) for r in kept) == sorted({_normal(t) for _, t in edge_rows})
    assert {r["doc_id"] for r in kept if r["text"]} >= {1, 3, 9, 10}


def test_exact_dedup_runs_no_python(make):
    plan = exact_dedup.exact_groups(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(values):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    """Levels from the nodes to one node."""
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([_sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def _way(tree, at):
    """Siblings on the way up, and the digests before and after by level."""
    way = []
    for level in tree[:-1]:
        low = at - at % 8
        way.append((level[low:at], level[at + 1 : low + 8]))
        at //= 8
    return way


def _proofs(rows, tampered):
    """doc_id, leaf, subroot, root, proof, folded root and verdict by plain Python."""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, _leaf(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: (_tree([m[2] for m in sorted(by_lang[x], key=lambda m: m[:3])])) for x in langs}
    top = _tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, (_, _, leaf, r) in enumerate(sorted(by_lang[x], key=lambda m: m[:3])):
            way = _way(trees[x], at) + _way(top, k)
            node = _leaf(tampered(r))
            for before, after in way:
                node = _sha("".join([*before, node, *after]))
            proof = _sha("".join("".join(b + a) for b, a in way))
            out.append((r[0], leaf, trees[x][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


FIELDS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("count", [0, 1, 8, 9, 700])
def test_proofs_equal_plain_python(spark, count):
    langs = [None, "", "de", "é", "en"]
    rows = [(i if i % 50 else None, "s" if i % 3 else None, "en" if i > 30 else langs[i % 5], i, f"Text {i % 40}" if i % 7 else None) for i in range(count)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, FIELDS).withColumn("group", F.lit(1)).withColumn("path", F.lit("x"))
    small = merkle.leaf(F.lower("text") if c == "text" else F.col(c) for c in merkle.FIELDS)
    claim = F.when(F.col("doc_id") % 3 == 0, small).otherwise(merkle.leaf(F.col(c) for c in merkle.FIELDS))
    got = merkle.verified(docs, claim=claim)
    tampered = lambda r: (*r[:4], r[4].lower()) if r[0] is not None and r[0] % 3 == 0 and r[4] else r
    assert sorted(map(tuple, got.collect()), key=str) == _proofs(rows, tampered)


def test_three_stored_levels_and_one_hot_group(spark):
    """More rows than one stored subtree holds, in one group, repeated rows among them."""
    rows = [(i % 4000, "s", "en", 1, "A") for i in range(5200)] + [(i, "s", f"l{i % 20}", 1, "B") for i in range(100)]
    got = merkle.verified(spark.createDataFrame(rows, FIELDS))
    assert sorted(map(tuple, got.collect()), key=str) == _proofs(rows, lambda r: r)


def test_levels_between_are_not_stored(spark):
    rows = spark.range(1500).select(F.lit("=a").alias("group"), F.col("id").alias("at"), F.lit(1500).cast("bigint").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    built = merkle.build(written(rows, "nodes"))
    assert [x.count() for x in built.stored] == [3, 1]
    nodes = [_sha(str(i)) for i in range(1500)]
    assert built.roots.first()["root"] == _tree(nodes)[-1][0]
    ways = merkle.paths(built).collect()
    assert len(ways) == 1500 and all(merkle.fold(nodes[r["at"]], r["path"]) == _tree(nodes)[-1][0] for r in ways[::97])
