"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with equal shingle sets form a class.  Shingles are dealt by their hash to parts, and each part finds those that more than
one class has, with exact counts; all others can be common to no pair.  So a class comes first with the shingles that it has
alone, then with shared ones by rising count, and its prefix is the first fifth of that order: two classes of similarity 0.8 share a
prefix shingle.  Classes that have a fifth of their shingles alone are linked with nothing and leave here.

Rounds of stars check every open class against one class of another component that shares a prefix shingle, which joins groups of
near copies along trees instead of pairs.  They go on until few pairs are left between components, or a round leaves most of them.
Then the remaining pairs that share a prefix shingle, lie in different components and pass the filters are checked: a few of each
two components first, and all whose components these did not join, so no link between components is lost.  Common shingles are counted on lists of shared shingles: no text is read again.

Defined results: null or empty text has no shingles and is linked with nothing; equal texts are linked; a null id stays
null and never names a component; repeated rows are returned as often as they come; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gramwise.llm.common import SHINGLE_WORDS, pieces, shingle_hashes, text_bytes, written
from gramwise.llm.graph import roots

#: Bytes of text whose shingles are found at once, or one document: each byte takes some forty while they are.
SET_BYTES = 1 << 19
#: Shingles of one part, about: what a task sorts at a time.
PART_SHINGLES = 1 << 21
#: Shingles that a task gathers before it sends them to the parts.
_GATHERED = 1 << 20
#: Classes of one gathering that may have a shingle in common before the rest goes another way than through its part.
COMMON = 1 << 12
#: Stands for the classes whose entries go that way.
_MARK = -(2**63)
#: Count of such a shingle, the same for all its classes: their prefixes need one order.
_VERY_COMMON = 1 << 30
#: Groups of classes in which the parts' findings are gathered; a power of two.  A part writes a row for each at most.
BUCKETS = 1 << 10
#: Rounds of stars go on as long as each leaves less than this share of the pairs between components.
PROGRESS = 0.75
#: Leads that a class is checked against in one round.
LEADS = 4
#: Pairs between components that are checked at once in any case.
FEW_PAIRS = 20_000
#: Pairs between components beyond which a few of each two components are compared first.
DRAWN_FROM = 1_000
#: Parts of the hash range in which the suffix filter counts shingles.
_BINS = 64


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The distinct shingles of each document, sorted."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for low, high in pieces(offsets, SET_BYTES):
            part = data[offsets[low] : offsets[high]]
            found = shingle_hashes(part, offsets[low : high + 1] - offsets[low], words)
            yield batch.slice(low, high - low), [np.unique(x) for x in found]


def _name(tokens: np.ndarray) -> int:
    """A set's class; the least number is kept for the mark."""
    return max(xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63, _MARK + 1)


def _described(docs: DataFrame, words: int, carried: Sequence[str]) -> DataFrame:
    """For each document its class (hash of its set) and size, and the carried columns."""

    def describe(batches):
        for rows, sets in _sets(batches, words):
            names, sizes = [_name(x) if len(x) else 0 for x in sets], [len(x) for x in sets]
            known = {c: rows.column(c) for c in ("doc_id", *carried)}
            yield pa.RecordBatch.from_pydict({**known, "class": pa.array(names, pa.int64()), "n": pa.array(sizes, pa.int32())})

    schema = docs.select("doc_id", *carried).schema
    return docs.mapInArrow(describe, StructType([*schema.fields, StructField("class", LongType()), StructField("n", IntegerType())]))


_BLOCK = "part int, classes binary, sizes binary, counts binary, tokens binary"


def _block(part: int, classes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    """Classes with the sizes of their sets, how many of the tokens are theirs, and the tokens, class after class."""
    values = (classes.astype("<i8"), sizes.astype("<i4"), counts.astype("<i4"), tokens.astype("<u8"))
    arrays = [pa.array([part], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "classes", "sizes", "counts", "tokens"])


def _dealt(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """All sets, cut up by part; a class that a task meets again is not sent again.

    Shingles that very many classes of one gathering have would fill their part: these entries go to parts beyond ``parts``, by class,
    and the shingle's own part only learns that others have it.
    """

    def sent(sets: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        names = np.array(names, np.int64)
        part = (tokens % np.uint64(parts)).astype(np.int64)
        found, at, often = np.unique(tokens, return_inverse=True, return_counts=True)
        common = found[often > COMMON]
        if len(common):
            apart = (often > COMMON)[at]
            part[apart] = parts + owner[apart] % parts
            marks = (common % np.uint64(parts)).astype(np.int64)
            for p in np.unique(marks):
                mine = common[marks == p]
                yield _block(int(p), np.array([_MARK]), np.array([0]), np.array([len(mine)]), mine)
        order = np.argsort(part, kind="stable")
        tokens, owner, part = tokens[order], owner[order], part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1) | np.diff(owner, prepend=-1))
        counts = np.diff(np.append(starts, len(tokens)))
        first = np.flatnonzero(np.diff(part[starts], prepend=-1))
        for low, high in zip(first, np.append(first[1:], len(starts)), strict=True):
            begin, end = starts[low], starts[high] if high < len(starts) else len(tokens)
            who = owner[starts[low:high]]
            yield _block(int(part[begin]), names[who], sizes[who], counts[low:high], tokens[begin:end])

    def deal(batches):
        sets, names, size, known = [], [], 0, set()
        for _, found in _sets(batches, words):
            for x in found:
                if not len(x):
                    continue
                name = _name(x)
                if name in known:
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                known.add(name)
                sets.append(x)
                names.append(name)
                size += len(x)
            if size > _GATHERED:
                yield from sent(sets, names)
                sets, names, size = [], [], 0
        if sets:
            yield from sent(sets, names)

    return docs.select("text").mapInArrow(deal, _BLOCK)


_LISTS = "bucket int, classes binary, sizes binary, counts binary, tokens binary, often binary"


def _shared(blocks: DataFrame, parts: int) -> DataFrame:
    """From each part the shingles that several classes have, by class, and how many have them: a row for each bucket of classes."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        part = rows[0][0]
        classes, sizes, counts = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((1, "<i8"), (2, "<i4"), (3, "<i4")))
        tokens = np.concatenate([np.frombuffer(r[4], "<u8") for r in rows])
        if part < parts:
            # One copy of each class is enough; marks are no class.
            _, first = np.unique(classes, return_index=True)
            keep = classes == _MARK
            keep[first] = True
            tokens = tokens[np.repeat(keep, counts)]
            classes, sizes, counts = classes[keep], sizes[keep], counts[keep]
        rows.clear()
        owner = np.repeat(np.arange(len(classes), dtype=np.int32), counts)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        del order
        starts = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        often = np.diff(np.append(starts, len(tokens))).astype(np.int32)
        weight = np.repeat(often, often)
        if part >= parts:
            weight[:] = _VERY_COMMON
        elif (marked := classes[owner] == _MARK).any():
            weight[np.repeat(np.logical_or.reduceat(marked, starts), often)] = _VERY_COMMON
        mine = (weight > 1) & (classes[owner] != _MARK)
        tokens, owner, weight = tokens[mine], owner[mine], weight[mine]
        if not len(owner):
            return
        bucket = (classes & (BUCKETS - 1)).astype(np.int32)
        order = np.lexsort((owner, bucket[owner]))
        tokens, owner, weight = tokens[order], owner[order], weight[order]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        counts = np.diff(np.append(starts, len(owner)))
        who = owner[starts]
        first = np.flatnonzero(np.diff(bucket[who], prepend=-1))
        found = []
        for low, high in zip(first, np.append(first[1:], len(starts)), strict=True):
            begin, end = starts[low], starts[high] if high < len(starts) else len(owner)
            values = (
                classes[who[low:high]].astype("<i8"), sizes[who[low:high]].astype("<i4"), counts[low:high].astype("<i4"),
                tokens[begin:end].astype("<u8"), weight[begin:end].astype("<i4"),
            )
            found.append((int(bucket[who[low]]), *(v.tobytes() for v in values)))
        kinds = (pa.int32(), *[pa.binary()] * 5)
        arrays = [pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "classes", "sizes", "counts", "tokens", "often"])

    # One part to a task: what a task holds, and what travels to it at once, is no more than a part or two.
    dealt = blocks.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("part").mapInArrow(_gathered(settle), _LISTS)


def _gathered(settle: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies ``settle`` to the rows of each first column's value, which come one after another."""

    def merge(batches):
        waiting: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = tuple(c[k].as_py() for c in batch.columns)
                if waiting and row[0] != waiting[0][0]:
                    yield from settle(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield from settle(waiting)

    return merge


def _candidates(lists: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Classes with a shared shingle in their prefix: ``class, n, alone, tokens, prefix, bins``; ``tokens`` are all shared ones, sorted."""

    def described(found: list[tuple]) -> pa.RecordBatch:
        names = ("class", "n", "alone", "tokens", "prefix", "bins")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int16()))
        return pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, k, v in zip(names, kinds, zip(*found, strict=True), strict=True)})

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = ("<i8", "<i4", "<i4", "<u8", "<i4")
        classes, sizes, counts, tokens, often = (np.concatenate([np.frombuffer(r[k + 1], t) for r in rows]) for k, t in enumerate(kinds))
        rows.clear()
        names, sizes = np.repeat(classes, counts), np.repeat(sizes, counts)
        order = np.lexsort((tokens, names))
        names, tokens = names[order], tokens[order]
        # The common ones of several gatherings may come twice.
        once = np.ones(len(order), bool)
        once[1:] = (names[1:] != names[:-1]) | (tokens[1:] != tokens[:-1])
        names, tokens, order = names[once], tokens[once], order[once]
        sizes, often = sizes[order], often[order]
        del order, once
        starts = np.append(True, names[1:] != names[:-1]).nonzero()[0]
        found, held = [], 0
        for low, high in zip(starts.tolist(), np.append(starts[1:], len(names)).tolist(), strict=True):
            n, x = int(sizes[low]), tokens[low:high]
            alone, keep = n - len(x), n - -(-num * n // den) + 1
            if alone < keep:
                rare = np.lexsort((x, often[low:high]))[: keep - alone]
                bins = np.minimum(np.bincount((x & np.uint64(_BINS - 1)).astype(np.int64), minlength=_BINS), 30_000)
                found.append((int(names[low]), n, alone, x.tobytes(), x[rare].view(np.int64), bins.astype(np.int16)))
                held += len(x)
            if held > _GATHERED:
                yield described(found)
                found, held = [], 0
        if found:
            yield described(found)

    buckets = lists.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return buckets.mapInArrow(_gathered(settle), "class bigint, n int, alone int, tokens binary, prefix array<bigint>, bins array<smallint>")


def _needed(num: int, den: int) -> F.Column:
    """Least number of common shingles of two linked sets of n_a and n_b: J >= num/den."""
    return F.ceil(F.lit(num) * (F.col("n_a") + F.col("n_b")) / F.lit(num + den) - 1e-9)


def _alike(num: int, den: int) -> F.Column:
    """Length filter, and suffix filter: shingles of one class alone, and shared ones counted in bins, differ by no more than linked sets can."""
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.abs(x - y).cast("int")), F.col("alone_a") + F.col("alone_b"), lambda total, x: total + x)
    return F.expr(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}") & (apart <= F.col("n_a") + F.col("n_b") - 2 * _needed(num, den))


def _alike_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, n_a, n_b`` of the pairs that length and suffix filter leave."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("class").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "alone", "bins"))), side)
    return pairs.filter(_alike(num, den)).select("a", "b", "n_a", "n_b")


def _verified(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a, b, n_a, n_b`` whose sets really are that similar; each is compared once."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("class").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)

    def compare(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "tokens_a", "tokens_b")), strict=True):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(den * common >= num * (n + m - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b").mapInArrow(compare, "a bigint, b bigint")


def _merged(components: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with a ``component`` by its new name in ``found(node, root)``."""
    named = components.join(found.withColumnRenamed("node", "component"), "component", "left")
    return named.withColumn("component", F.coalesce("root", "component")).drop("root")


def _joined(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, root`` of the components that ``links(a, b)`` between classes join: only these are followed, not all links again."""
    links = _named(links, labels)
    return written(roots(links.select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))), "joined")


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of classes with ``component_a, component_b``."""
    for side in "ab":
        pairs = pairs.join(labels.select(F.col("class").alias(side), F.col("component").alias(f"component_{side}")), side)
    return pairs


def _open(postings: DataFrame, found: DataFrame, attempt: int) -> DataFrame:
    """Postings of the tokens that several components share; ``lead`` is one class of each token, another each attempt.

    ``found`` names the components anew; ``across`` is, for each token, the pairs of its classes that lie in different components.
    """
    named = _merged(postings.select("token", "class", "n", "pos", "component"), found)
    # Each token draws for itself: a class meets different leads by its different tokens.
    drawn = F.min(F.struct(F.xxhash64("class", "token", F.lit(attempt)).alias("draw"), "class", "component", "n"))
    mixed = named.groupBy("token", "component").agg(F.count(F.lit(1)).cast("double").alias("m"), drawn.alias("x")).groupBy("token").agg(
        F.min("x").alias("x"), F.count(F.lit(1)).alias("components"), ((F.pow(F.sum("m"), F.lit(2.0)) - F.sum(F.col("m") * F.col("m"))) / 2).alias("across")
    )
    mixed = mixed.filter("components > 1").select("token", "across", F.col("x.class").alias("lead"), F.col("x.component").alias("lead_component"), F.col("x.n").alias("lead_n"))
    return written(named.join(mixed, "token"), "open")


def _stars(postings: DataFrame, attempt: int, num: int, den: int) -> DataFrame:
    """``a, b``: for each class some of its tokens' leads of a size that can be linked, others each attempt; every pair once."""
    n, lead_n = F.col("n").cast("bigint"), F.col("lead_n").cast("bigint")
    postings = postings.filter(F.least(n, lead_n) * den >= F.greatest(n, lead_n) * num)
    drawn = F.transform(F.collect_set("lead"), lambda x: F.struct(F.xxhash64(x, F.lit(-attempt)).alias("draw"), x.alias("y")))
    some = postings.groupBy(F.col("class").alias("x")).agg(F.slice(F.array_sort(drawn), 1, LEADS).alias("leads"))
    pairs = some.select("x", F.explode("leads.y").alias("y"))
    return written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "stars")


def _between(pairs: DataFrame, classes: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """``labels(class, component)`` after the links among ``pairs(a, b, n_a, n_b, component_a, component_b)``.

    One link joins two components, however many their classes have: a few pairs of each two components are compared first, and
    all of those that are still apart after that.  As many pairs as classes cost no more than another round.
    """

    def after(some: DataFrame) -> DataFrame:
        # No other classes travel.
        few = classes.join(some.select(F.explode(F.array("a", "b")).alias("class")), "class", "left_semi")
        return written(_merged(labels, _joined(_verified(some, few, num, den), labels)), "labels")

    left, before, attempt = pairs.count(), float("inf"), 0
    while left > max(DRAWN_FROM, labels.count()) and left <= PROGRESS * before:
        drawn = [F.min(F.struct(F.xxhash64("a", "b", F.lit(LEADS * attempt + k)).alias("draw"), "a", "b", "n_a", "n_b")) for k in range(LEADS)]
        two = F.least("component_a", "component_b").alias("low"), F.greatest("component_a", "component_b").alias("high")
        some = pairs.groupBy(*two).agg(F.array(*drawn).alias("drawn")).select(F.explode("drawn").alias("x"))
        some = written(some.select("x.a", "x.b", "x.n_a", "x.n_b").distinct(), "drawn")
        labels = after(some)
        pairs = _named(pairs.select("a", "b", "n_a", "n_b").join(some.select("a", "b"), ["a", "b"], "left_anti"), labels)
        pairs = written(pairs.filter("component_a <> component_b"), "pairs")
        before, left, attempt = left, pairs.count(), attempt + 1
    return after(pairs.select("a", "b", "n_a", "n_b"))


def link_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE_WORDS, similarity: tuple[int, int] = (80, 100),
    carried: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest id that links reach), and what is ``carried``.

    With carried columns there is also ``group``, which names the component of documents without an id as well and is null for those
    without shingles.
    """
    num, den = similarity
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"), *carried)
    rows = written(_described(docs, words, carried), "classes")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_SHINGLES))
    classes = written(_candidates(_shared(_dealt(docs, words, parts), parts), num, den, parts), "candidates")
    # One exchange by token serves both the leaders and the join with them.
    postings = classes.select("class", "n", "alone", F.posexplode("prefix").alias("at", "token"))
    postings = postings.select("token", "class", "n", (F.col("alone") + F.col("at")).alias("pos")).repartition("token")
    drawn = F.min_by(F.struct("class", "n", "pos"), F.xxhash64("class", "token"))
    leaders = postings.groupBy("token").agg(F.count(F.lit(1)).alias("found"), drawn.alias("x")).filter("found > 1")
    leaders = leaders.select("token", F.col("x.class").alias("lead"), F.col("x.n").alias("lead_n"))
    shared = written(postings.join(leaders, "token"), "postings")

    # Stars: each class is checked against a few classes, and what is left open against some of other components.
    links = _verified(_alike_pairs(_stars(shared.filter("class <> lead"), 0, num, den), classes, num, den), classes, num, den)
    found = written(roots(links), "joined")
    labels = written(_merged(classes.select("class", F.col("class").alias("component")), found), "labels")
    open_ = _open(shared.withColumn("component", F.col("class")), found, 0)
    attempt, before = 0, float("inf")
    while True:
        left = open_.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.first("across").alias("across"))
        left = left.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("across"), F.lit(0.0)).alias("pairs")).first()
        # Checking all pairs at once now costs less than another round, or rounds no longer help.
        if left["pairs"] <= max(left["n"] / 4, FEW_PAIRS) or left["pairs"] > PROGRESS * before:
            break
        before, attempt = left["pairs"], attempt + 1
        stars = _stars(open_.filter("component <> lead_component"), attempt, num, den)
        found = _joined(_verified(_alike_pairs(stars, classes, num, den), classes, num, den), labels)
        labels = written(_merged(labels, found), "labels")
        open_ = _open(open_, found, attempt)

    # Linked sizes differ by a factor of at most den/num, so the larger is at most one step further on this scale.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    sized = open_.select("token", "class", "pos", "component").join(classes.select("class", "n", "alone", "bins"), "class").withColumn("step", step)
    right = sized.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"))))
    columns = ("class", "n", "alone", "pos", "component", "bins")
    left, right = (x.select("token", "step", *(F.col(c).alias(f"{c}_{s}") for c in columns)) for x, s in ((sized, "a"), (right, "b")))
    # At the first shingle that two prefixes share, what follows must hold all that linked sets have in common.
    follows = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    pairs = (
        left.join(right, ["token", "step"])
        .filter("(n_a < n_b or n_a = n_b and class_a < class_b) and component_a <> component_b")
        .filter((follows >= _needed(num, den)) & _alike(num, den))
        .select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "n_a", "n_b", "component_a", "component_b")
        .distinct()
    )
    labels = _between(written(pairs, "pairs"), classes, labels, num, den)

    sets = rows.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("low")).join(labels, "class", "left")
    sets = sets.select("class", "low", F.coalesce("component", "class").alias("component"))
    lowest = sets.groupBy("component").agg(F.min("low").alias("component_id"))
    named = sets.join(lowest, "component").select("class", "component_id", F.col("component").alias("group"))
    out = rows.withColumn("class", F.when(F.col("n") > 0, F.col("class"))).join(named, "class", "left")
    more = [*carried, "group"] if carried else []
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Links of all documents by five-word shingles at similarity 0.8."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sh as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as s
  from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
n as (select d.doc_id, count(s) as n from d left join sh using (doc_id) group by all),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b using (s) where a.doc_id <> b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) as (select doc_id, doc_id from n union select r.a, e.b from r join e on e.a = r.b)
select n.doc_id, n.n::bigint as n_shingles, min(r.b) as component_id from n join r on r.a = n.doc_id group by all
"""
