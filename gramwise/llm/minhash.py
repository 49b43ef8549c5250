"""MinHash fingerprints of word shingles.

A fingerprint is the least value of each of many universal hash functions over a text's shingles; the share of equal
values estimates the Jaccard similarity.  Texts with equal bands of values are joined in Spark and their shingle sets compared.

Defined results: null and empty text have no shingles, the fingerprint of all ones, likeness 1 to each other and 0 to
other texts; texts of one to four words have one shingle; repeated rows are fingerprinted as often as they come; null ids sort
last; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.llm.common import SHINGLE_WORDS, shingle_hashes, table, text_bytes, written
from gramwise.llm.graph import components

PERMUTATIONS = 64
_EMPTY = np.uint32(0xFFFFFFFF)
_RNG = np.random.Generator(np.random.PCG64(20260102))
_FACTOR = _RNG.integers(0, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 2**32, 256, dtype=np.uint32)
#: Documents of a range in which neighbours are found.
RANGE_ROWS = 20_000
#: With more documents the ranges grow, not their number.
MOST_RANGES = 20_000


def signature(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The least value of each hash function x -> ax + b modulo 2**32 with odd a, over the upper half of the hashes."""
    if not len(shingles):
        return np.full(permutations, _EMPTY)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty(permutations, np.uint32)
    for k in range(permutations):
        out[k] = (x * _FACTOR[k] + _SHIFT[k]).min()
    return out


def signatures(texts: list[bytes], permutations: int = PERMUTATIONS, words: int = SHINGLE_WORDS) -> np.ndarray:
    """One row of least values for each text, all texts at once."""
    offsets = np.cumsum([0, *map(len, texts)])
    found = shingle_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets, words)
    sizes = np.array([len(x) for x in found], np.int64)
    out = np.full((len(texts), permutations), _EMPTY)
    full = np.flatnonzero(sizes)
    if len(full):
        x = (np.concatenate([found[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(sizes[full]) - sizes[full]
        for k in range(permutations):
            out[full, k] = np.minimum.reduceat(x * _FACTOR[k] + _SHIFT[k], starts)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal values of two fingerprints."""
    return (a == b).mean(-1)


def _text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


# --- neighbours ---------------------------------------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many characters from the start of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _ranges(docs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The documents with ``range``, numbered in descending order of id; the first document of each range is also
    given, as ``borrowed``, to the range before, and the first of all to the last.

    Ranges are cut at ids drawn by hash, some 50 for each; what the driver holds is bounded by ``MOST_RANGES``.
    """
    spark = docs.sparkSession
    total = docs.count()
    number = min(max(1, -(-total // rows)), MOST_RANGES)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) / 1e9
    drawn = docs.filter(draw < 50 * number / max(total, 1)).select("doc_id").dropna().collect() if number > 1 else []
    ids = sorted(float(r["doc_id"]) for r in drawn)
    cuts = sorted({ids[len(ids) * i // number] for i in range(1, number)}) if ids else []
    placed = docs.withColumn("range", F.lit(0))
    if cuts:
        # Searched by halves; a null id is in the last range.
        found = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at", outputCol="cut", handleInvalid="keep")
        at = found.transform(docs.withColumn("at", F.col("doc_id").cast("double")))
        number_of = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(len(cuts) - F.col("cut").cast("int"))
        placed = at.withColumn("range", number_of).drop("at", "cut")
    firsts = placed.groupBy("range").agg(F.max("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    if not firsts:
        return placed.withColumn("borrowed", F.lit(False)), 0
    if any(x["first"] is None for x in firsts[:-1]):
        raise ValueError("ids are null outside the last range")
    before = {x["range"]: firsts[i - 1]["range"] for i, x in enumerate(firsts)}
    first = spark.createDataFrame([(x["range"], x["first"], before[x["range"]]) for x in firsts], "range int, first bigint, earlier int")
    lent = placed.join(F.broadcast(first), "range").filter(F.col("doc_id").eqNullSafe(F.col("first")))
    lent = lent.select("doc_id", "text", F.col("earlier").alias("range"), F.lit(True).alias("borrowed"))
    return placed.withColumn("borrowed", F.lit(False)).unionByName(lent), len(firsts)


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, words: int = SHINGLE_WORDS, rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of their edited texts, with the likeness to those and to the next document.

    A range of ids lies in one partition, sorted, and knows its successor's first row.
    Rows with equal ids follow one another by text, so every order of the input gives the same neighbours.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed, number = _ranges(docs, rows)
    order = [F.col("range"), F.col("borrowed"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    # A range has its partition to itself: a hash of the number would put several together.
    ordered = placed.repartitionById(max(number, 1), F.col("range")).sortWithinPartitions(*order)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def describe(batches):
        waiting: list[tuple] = []  # rows whose successor may be the next one to come, the signature as the last field
        group = None
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                texts = part.column("text").to_pylist()
                found = signatures([x.encode() for x in texts], permutations, words)
                rows_ = list(zip(part.column("range").to_pylist(), part.column("borrowed").to_pylist(), part.column("doc_id").to_pylist(), texts, found, strict=True))
                pairs = []
                for row in rows_:
                    if row[0] != group:
                        group, waiting = row[0], []
                    if waiting and not waiting[0][1]:
                        pairs.append((waiting[0], row))
                    waiting = [row]
                if pairs:
                    yield described(pairs)

    def described(pairs):
        after = [edited(a[3], b[3]) for a, b in pairs]
        changed = signatures([x.encode() for x in after], permutations, words)
        own, following = np.stack([a[4] for a, _ in pairs]), np.stack([b[4] for _, b in pairs])
        columns = [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in after]),
            pa.array([_text(x) for x in own]),
            pa.array([_text(x) for x in changed]),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, following)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(describe, schema)


# --- near duplicates ----------------------------------------------------------------------------------------------


def _sets(docs: DataFrame, bands: int, permutations: int, words: int) -> DataFrame:
    """For each document with shingles a digest of its set, a key for each band of its fingerprint, and its set."""
    per = permutations // bands

    def describe(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                data, offsets = text_bytes(part.column("text"))
                sets = [np.unique(x) for x in shingle_hashes(data, offsets, words)]
                keep = [i for i, x in enumerate(sets) if len(x)]
                values = {i: signature(sets[i], permutations) for i in keep}
                keys = [[hashlib.blake2b(bytes([b]) + values[i][b * per : (b + 1) * per].tobytes(), digest_size=8).digest() for b in range(bands)] for i in keep]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(keep, pa.int64())),
                        "digest": pa.array([hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in keep], pa.binary()),
                        "bands": pa.array(keys, pa.list_(pa.binary())),
                        "tokens": pa.array([sets[i].tobytes() for i in keep], pa.binary()),
                    }
                )

    return written(docs.mapInArrow(describe, "doc_id bigint, digest binary, bands array<binary>, tokens binary"), "fingerprints")


def _verified(pairs: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of classes with the similarity of their sets, where it is high enough."""
    for side in "ab":
        pairs = pairs.join(first.select(F.col("class_id").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)

    def verify(batches):
        for batch in batches:
            kept = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "tokens_a", "tokens_b")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= similarity * (len(x) + len(y) - common):
                    kept.append((a, b, common / (len(x) + len(y) - common)))
            fields = (("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64()))
            yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in kept], t) for i, (c, t) in enumerate(fields)})

    return pairs.select("a", "b", "tokens_a", "tokens_b").mapInArrow(verify, "a bigint, b bigint, jaccard double")


def _linked(docs: DataFrame, similarity: float, bands: int, permutations: int, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null")
    rows = _sets(docs, bands, permutations, words)
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    first = rows.join(classes, "digest").filter("doc_id = class_id").dropDuplicates(["class_id", "digest"])
    postings = written(first.select("class_id", F.explode("bands").alias("band")), "bands")
    leaders = postings.groupBy("band").agg(F.min("class_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = postings.join(leaders, "band").filter("class_id <> a").select("a", F.col("class_id").alias("b")).distinct()
    links = written(_verified(stars, first, similarity), "links")
    # Classes of one band that the stars have not joined are compared with one another.
    named = postings.join(components(links).withColumnRenamed("node", "class_id"), "class_id", "left")
    named = named.withColumn("component", F.coalesce("component", "class_id"))
    mixed = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band")
    open_ = written(named.join(mixed, "band", "left_semi"), "open")
    left, right = (open_.select("band", F.col("class_id").alias(s), F.col("component").alias(f"c_{s}")) for s in "ab")
    more = left.join(right, "band").filter("a < b and c_a <> c_b").select("a", "b").distinct()
    return docs, rows.join(classes, "digest").select("doc_id", "class_id"), links.unionByName(_verified(more, first, similarity))


def near_pairs(docs: DataFrame, similarity: float = 0.8, bands: int = 16, permutations: int = PERMUTATIONS, words: int = SHINGLE_WORDS) -> DataFrame:
    """Links ``a, b, jaccard`` between classes, enough to join every two classes that share a band and are that similar.

    Documents with equal sets of shingles form a class, named by its smallest id.  In each band every class is compared with the
    smallest class that has the same values, and then with those that this has not joined.
    """
    return _linked(docs, similarity, bands, permutations, words)[2]


def near_classes(docs: DataFrame, similarity: float = 0.8, bands: int = 16, permutations: int = PERMUTATIONS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, component_id`` for every document with an id: the smallest id that links reach, its own without any."""
    docs, members, links = _linked(docs, similarity, bands, permutations, words)
    labels = components(links).withColumnRenamed("node", "class_id")
    named = members.join(labels, "class_id", "left").select("doc_id", F.coalesce("component", "class_id").alias("component_id")).distinct()
    return docs.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
