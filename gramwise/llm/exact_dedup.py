"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash, in DataFrame functions only.

The first pass over the texts writes a slim row for each document: its number, id, length and the hash of its first characters.
Lengths that several documents share are found from these rows, and among them the prefixes that several share.  The second
pass hashes the full content of documents in such groups only.  It knows them by a bit set of bounded size over the hashes of the
surviving groups, joined slice by slice, so that no text is shuffled; what passes by chance is told apart by the full hash.

Defined results: null text is empty; equal texts are those that agree after every run of ASCII white space became one space; of a
group the row with the smallest id stays, rows without an id after all others; of repeated rows with that id one stays; a group
of rows without ids has a null ``keep_id``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramwise.llm.common import table, written

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 64
#: Bits of one slice of the set of surviving groups, as 64 numbers.
_SLICE_BITS = 4096
#: Slices that are sent at most: 16 MB.  A fuller set lets more documents pass to the full hash, and loses none.
MAX_SLICES = 1 << 15
#: Groups with more than this share of all rows are joined by broadcast; there are fewer than its inverse of them.
HOT_SHARE = 1e-3


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _bit_set(keys: DataFrame, slices: int) -> DataFrame:
    """``slice, words``: the set of all values of ``keys(key)``, hashes, as at most ``slices`` rows of 64 numbers."""
    at = F.pmod("key", F.lit(slices * _SLICE_BITS))
    bits = keys.select(
        F.call_function("div", at, F.lit(_SLICE_BITS)).cast("int").alias("slice"),
        F.call_function("div", at % _SLICE_BITS, F.lit(64)).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("bit"),
    )
    words = bits.groupBy("slice", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("slice").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _in_set(key: Column, words: Column, slices: int) -> Column:
    at = F.pmod(key, F.lit(slices * _SLICE_BITS))
    word = F.call_function("div", at % _SLICE_BITS, F.lit(64)).cast("int")
    found = F.call_function("getbit", F.try_element_at(words, word), (at % 64).cast("int"))
    return F.coalesce(found == 1, F.lit(False))


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The digest is null where length or prefix told a document apart before its content was needed, unless ``digest_all``.
    """
    clean = normalised(F.col(text_column))
    rows = docs.select(F.col(id_column).alias("doc_id"), clean.alias("clean"))
    head = F.xxhash64(F.length("clean"), F.substring("clean", 1, prefix_chars))
    slim = written(rows.select(F.length("clean").alias("length"), head.alias("prefix")), "lengths")

    lengths = slim.groupBy("length").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("length")
    # Counted before the join: a group of copies is one row of each task by then.
    heads = slim.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("rows")).join(lengths, "length", "left_semi")
    keys = written(heads.filter("rows > 1").select(F.col("prefix").alias("key")), "prefixes")
    slices = min(MAX_SLICES, 1 << max(0, (16 * keys.count() // _SLICE_BITS).bit_length()))
    # Bounded: at most ``slices`` rows of 64 numbers.
    known = F.broadcast(_bit_set(keys, slices))

    part = F.call_function("div", F.pmod(head, F.lit(slices * _SLICE_BITS)), F.lit(_SLICE_BITS)).cast("int")
    marked = rows.withColumn("prefix", head).withColumn("slice", part).join(known, "slice", "left")
    survives = _in_set(F.col("prefix"), F.col("words"), slices)
    digest = F.sha2("clean", 256)
    full = digest if digest_all else F.when(survives, digest)
    whole = written(
        marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", survives.alias("survives"), full.alias("text_sha256")), "digests"
    )

    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    groups = whole.filter("survives").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    groups = written(groups.filter("group_size > 1").select("text_sha256", "group_size", "first.keep_id", "first.keep_row"), "groups")
    total = whole.count()
    hot = groups.filter(F.col("group_size") > HOT_SHARE * total)
    names = ("group_size", "keep_id", "keep_row")
    hot = F.broadcast(hot.select("text_sha256", *(F.col(c).alias(f"hot_{c}") for c in names)))
    cold = groups.filter(F.col("group_size") <= HOT_SHARE * total)
    joined = whole.join(hot, "text_sha256", "left")
    # Rows that need no other group keep apart from each other: their own number stands for the digest.
    alone = F.col("hot_keep_row").isNotNull() | ~F.col("survives")
    joined = joined.withColumn("group", F.when(alone, F.col("row").cast("string")).otherwise(F.col("text_sha256")))
    joined = joined.join(cold.withColumnRenamed("text_sha256", "group"), "group", "left")
    size, keep, keep_row = (F.coalesce(f"hot_{c}", c) for c in names)
    in_group = size.isNotNull()
    return joined.select(
        "doc_id",
        F.when(in_group, keep).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce(size, F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(keep_row == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents of ``docs`` whose text no other row with a smaller id has; all columns stay.

    Rows are found again by id and text, so repeated rows of one id are told apart by their number of copies: one stays.
    """
    groups = exact_groups(docs, id_column, text_column, digest_all=True).filter("kept")
    kept = groups.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    marked = docs.withColumn("__digest", F.sha2(normalised(F.col(text_column)), 256))
    first = marked.dropDuplicates([id_column, "__digest"])
    same = first[id_column].eqNullSafe(kept["__id"]) & (first["__digest"] == kept["__digest"])
    return first.join(kept, same, "left_semi").drop("__digest")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


ORACLE = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by t) as group_size, row_number() over g = 1 as kept, sha256(t) as text_sha256
from d window g as (partition by t order by doc_id nulls last)
"""
