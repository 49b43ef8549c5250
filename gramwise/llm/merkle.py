"""Merkle manifest of a dataset: a tree of digests for each group, their roots under one root, proofs for every row.

Checkpoint and recompute: of the levels of a tree only every third is stored, as aligned subtrees of 512 nodes each; the two
levels between are never written.  Proofs are made from the top down.  For each stored subtree the missing interior nodes are
regenerated from its stored nodes, the siblings on the way of each of them are emitted in front of the path of the subtree's own
root, and the regenerated nodes are discarded.

A path is a text with one part for each level, separated by ``/``: the digests of a run from left to right, with ``*`` in the place
of the node that is proved.  A leaf's position is its rank within its group, found by a range sort and running counts.

Defined results: fields that are null count as ``-``; rows with equal order keep both, side by side, sorted by leaf; null order comes
first; a null group is a group of its own, the first; an empty table has no rows and no root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gramwise.llm.common import table, written

FAN_OUT = 8
#: Levels between two stored ones, and so the nodes of a stored subtree: 8 ** 3.
KEPT_EVERY = 3
SUBTREE = FAN_OUT**KEPT_EVERY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: Iterable[Column]) -> Column:
    """Digest of the values, each as its length in UTF-8 bytes, a colon and its text."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _group_key(group: Column) -> Column:
    """Text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def levels_above(nodes: Sequence[str], levels: int) -> list[list[str]]:
    """``nodes`` and the ``levels`` levels above them, regenerated."""
    out = [list(nodes)]
    for _ in range(levels):
        below = out[-1]
        out.append([_digest("".join(below[i : i + FAN_OUT])) for i in range(0, len(below), FAN_OUT)])
    return out


def paths_in(nodes: Sequence[str], levels: int) -> list[str]:
    """For each of the nodes the parts of its path up to ``levels`` levels above."""
    tree = levels_above(nodes, levels)
    ways = [""] * len(nodes)
    for depth in range(levels):
        row, size = tree[depth], FAN_OUT**depth
        parts = []
        for at in range(len(row)):
            low = at - at % FAN_OUT
            run = row[low : low + FAN_OUT]
            run[at - low] = "*"
            parts.append("".join(run))
        for i in range(len(nodes)):
            ways[i] += ("/" if depth else "") + parts[i // size]
    return ways


def fold(digest: str, path: str) -> str:
    """The root that follows from a digest and its path."""
    for part in path.split("/") if path else ():
        digest = _digest(part.replace("*", digest))
    return digest


def _levels(count: int) -> int:
    """Levels from so many nodes to a single one."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FAN_OUT), levels + 1
    return levels


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``at``, the rank within ``group`` (never null) by ``order`` from 0, and ``n``, the rows of the group."""
    # A number for each row lets equal rows be dealt to several tasks.
    rows = written(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    keys = ["group", *order, "tie"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, next_ = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("group").dictionary_encode()
            code = groups.indices.to_numpy()
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            within = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
            if groups.dictionary[int(code[0])].as_py() == last:
                within[: starts[1] if len(starts) > 1 else len(code)] += next_
            last, next_ = groups.dictionary[int(code[-1])].as_py(), int(within[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)], names=[*batch.schema.names, "within"])

    schema = StructType([*dealt.schema.fields, StructField("within", LongType())])
    placed = written(dealt.mapInArrow(number, schema), "placed")
    counts = placed.groupBy("part", "group").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "group", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy("group")).alias("n"))
    return placed.join(starts, ["part", "group"]).withColumn("at", F.col("start") + F.col("within")).drop("part", "tie", "within", "start")


@dataclass(frozen=True)
class Forest:
    """Trees over groups of nodes: the stored levels, lowest first, and ``roots(group, root)``."""

    stored: tuple[DataFrame, ...]
    roots: DataFrame


def _packed(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """``group, subtree, n, nodes``: aligned runs of at most 512 nodes in order, with what else travels with them."""
    members = F.array_sort(F.collect_list(F.struct("at", "digest", *payload)))
    return nodes.groupBy("group", F.call_function("div", F.col("at"), F.lit(SUBTREE)).alias("subtree"), "n").agg(members.alias("nodes"))


def build(nodes: DataFrame, payload: Sequence[str] = ()) -> Forest:
    """Trees over ``nodes(group, at, n, digest, *payload)``; one table for every third level and one of roots is stored."""

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column("nodes").to_pylist()
            tops = [levels_above(x, min(KEPT_EVERY, _levels(n)))[-1][0] for x, n in zip(digests, batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("subtree"), batch.column("n"), pa.array(tops, pa.string())], names=["group", "at", "n", "digest"])

    stored, roots, level = [], [], nodes
    while True:
        packed = written(_packed(level, payload if not stored else ()), "subtrees")
        stored.append(packed)
        tops = packed.select("group", "subtree", "n", F.col("nodes.digest").alias("nodes")).mapInArrow(above, "group string, at bigint, n bigint, digest string")
        tops = written(tops.withColumn("n", F.ceil(F.col("n") / SUBTREE)), "nodes")
        roots.append(tops.filter("n = 1").select("group", F.col("digest").alias("root")))
        level = tops.filter("n > 1")
        if level.isEmpty():
            break
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.unionByName(more)
    return Forest(tuple(stored), whole)


def paths(forest: Forest, carried: Sequence[str] = (), tops: DataFrame | None = None, finish=None, schema: str | None = None) -> DataFrame:
    """The path of every node of the lowest level, ``group, at, path`` and what ``tops`` carries.

    ``tops(group, path, *carried)`` holds what lies above each root.  ``finish(nodes, paths, row)``, where given, makes the final
    rows of ``schema`` from the lowest subtrees inside the task, so that the paths themselves need not be written.
    """
    if tops is None:
        tops = forest.roots.select("group", F.lit("").alias("path"))
    carried_schema = "".join(f", {c} string" for c in carried)

    def regenerate(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = row["nodes"]
                ways = paths_in([x["digest"] for x in nodes], min(KEPT_EVERY, _levels(row["n"])))
                ways = ["/".join(x for x in (way, row["path"]) if x) for way in ways]
                if last and finish:
                    yield finish(nodes, ways, row)
                    continue
                n = len(nodes)
                columns = {"group": pa.array([row["group"]] * n, pa.string()), "at": pa.array([x["at"] for x in nodes], pa.int64()), "path": pa.array(ways, pa.string())}
                yield pa.RecordBatch.from_pydict(columns | {c: pa.array([row[c]] * n, pa.string()) for c in carried})

    plain = f"group string, at bigint, path string{carried_schema}"
    known = None
    for depth in reversed(range(len(forest.stored))):
        packed, last = forest.stored[depth], depth == 0
        # Trees that end at this level start from their top, the others from the paths of the level above.
        here = packed.filter(F.col("n") <= SUBTREE).join(tops, "group")
        if known is not None:
            here = here.unionByName(packed.filter(F.col("n") > SUBTREE).join(known.withColumnRenamed("at", "subtree"), ["group", "subtree"]).select(here.columns))
        made = here.mapInArrow(lambda batches, last=last: regenerate(batches, last), schema if last and finish else plain)
        known = made if last else written(made, "paths")
    return known


@dataclass(frozen=True)
class Manifest:
    """The leaves' trees by group, and the tree over their roots."""

    leaves: Forest
    groups: Forest
    #: ``group, subroot, root, path``: the way from each subroot to the root.
    tops: DataFrame


def manifest(rows: DataFrame, order: Sequence[str], payload: Sequence[str] = ()) -> Manifest:
    """Trees over ``rows(group, digest, *order, *payload)``; ``group`` is text and never null."""
    leaves = build(ranked(rows, [*order, "digest"]), payload)
    subroots = leaves.roots.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("root").alias("digest"))
    groups = build(ranked(subroots, ["name"]), ["name"])

    def named(nodes, ways, row):
        n = len(nodes)
        columns = {"group": [x["name"] for x in nodes], "subroot": [x["digest"] for x in nodes], "root": [row["root"]] * n, "path": ways}
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in columns.items()})

    top = groups.roots.select("group", "root", F.lit("").alias("path"))
    tops = paths(groups, ["root"], top, named, "group string, subroot string, root string, path string")
    return Manifest(leaves, groups, written(tops, "tops"))


def verified(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", claim: Column | None = None) -> DataFrame:
    """Proofs of all rows: ``<order>, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``claim`` is the digest that is checked against the manifest, the row's own leaf if not given.
    """
    own = leaf(F.col(c) for c in fields)
    rows = docs.select(_group_key(F.col(group)).alias("group"), F.col(order).cast("bigint").alias("id"), own.alias("digest"), (own if claim is None else claim).alias("claim"))
    # A claim that equals the leaf need not travel twice.
    rows = rows.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim")))
    built = manifest(rows, ["id"], ["id", "claim"])

    def finish(nodes, ways, row):
        leaves = [x["digest"] for x in nodes]
        folded = [fold(x["claim"] or x["digest"], way) for x, way in zip(nodes, ways, strict=True)]
        proofs = [_digest(way.replace("*", "").replace("/", "")) for way in ways]
        n = len(nodes)
        columns = {
            order: pa.array([x["id"] for x in nodes], pa.int64()),
            "leaf": pa.array(leaves, pa.string()),
            "subroot": pa.array([row["subroot"]] * n, pa.string()),
            "root": pa.array([row["root"]] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([x == row["root"] for x in folded], pa.bool_()),
        }
        return pa.RecordBatch.from_pydict(columns)

    schema = f"{order} bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return paths(built.leaves, ["subroot", "root"], built.tops, finish, schema)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents; where 3 divides crc32 of the id, the text offered for checking is in lower case."""
    docs = table(spark, sf_dir, "documents")
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = leaf(F.translate("text", capitals, small) if c == "text" else F.col(c) for c in FIELDS)
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    own = leaf(F.col(c) for c in FIELDS)
    return verified(docs, claim=F.when(chosen, tampered).otherwise(own))


ORACLE = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t),
d as (
  select row_number() over () as r, doc_id, lang,
    list_transform([doc_id::varchar, source, lang, n_chars::varchar], lambda x: coalesce(strlen(x)::varchar || ':' || x, '-')) as h, text,
    coalesce(xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 3 = 0, false) as hit
  from documents, crc),
l as (
  select *, sha256(array_to_string(h, '') || coalesce(strlen(text)::varchar || ':' || text, '-')) as leaf,
    case when hit then sha256(array_to_string(h, '') || coalesce(strlen(text)::varchar || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
      else sha256(array_to_string(h, '') || coalesce(strlen(text)::varchar || ':' || text, '-')) end as claim
  from d),
p as (select r, doc_id, coalesce('=' || lang, '') as g, leaf, claim, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from l),
t(g, level, pos, n, h) as (
  select g, 0, pos, n, leaf from p
  union all
  select g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by g, level, pos // 8, n),
s as (select g, h as subroot, row_number() over (order by g) - 1 as pos, count(*) over () as n from t where n = 1),
u(level, pos, n, h) as (
  select 0, pos, n, subroot from s
  union all
  select level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from u where n > 1 group by level, pos // 8, n),
f(r, level, pos, g, h, proof) as (
  select r, 0, pos, g, claim, '' from p
  union all
  select f.r, f.level + 1, f.pos // 8, f.g, sha256(string_agg(case when t.pos = f.pos then f.h else t.h end, '' order by t.pos)),
    f.proof || coalesce(string_agg(case when t.pos <> f.pos then t.h end, '' order by t.pos), '')
  from f join t on t.g = f.g and t.level = f.level and t.pos // 8 = f.pos // 8 where t.n > 1 group by f.r, f.level, f.pos, f.g, f.h, f.proof),
top as (select f.r, f.g, f.h, f.proof from f where f.level = (select max(t.level) from t where t.g = f.g)),
k(r, level, pos, h, proof) as (
  select top.r, 0, s.pos, top.h, top.proof from top join s using (g)
  union all
  select k.r, k.level + 1, k.pos // 8, sha256(string_agg(case when u.pos = k.pos then k.h else u.h end, '' order by u.pos)),
    k.proof || coalesce(string_agg(case when u.pos <> k.pos then u.h end, '' order by u.pos), '')
  from k join u on u.level = k.level and u.pos // 8 = k.pos // 8 where u.n > 1 group by k.r, k.level, k.pos, k.h, k.proof)
select p.doc_id, p.leaf, s.subroot, root.h as root, sha256(k.proof) as proof_sha256, k.h as folded_root, k.h = root.h as verified
from p join s using (g) join k using (r), (select h from u where n = 1) root where k.level = (select max(level) from u)
"""
