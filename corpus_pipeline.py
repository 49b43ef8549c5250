"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next one's
documents, so a stage may first free what the one before it has sent to the executors.  All but the last return the columns of
``documents``.  Null texts and texts without a letter go in the first stage; rows that differ in nothing count as copies; an empty
table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwise.llm import decontaminate, language, ngram_join, packing, secrets
from gramwise.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this certainty a text is in no language that was learned.
LEAST_CERTAINTY = 0.5


#: Broadcasts of the stage that has been written.
_sent: list = []


def _free() -> None:
    """Called by the next stage: its documents are a table by then, and the executors need the model no more."""
    while _sent:
        _sent.pop().destroy()


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is certain enough, and corrects ``lang`` to it."""
    model = language.fit(docs.select("text", "lang"))
    found = language.identify(docs.select(*COLUMNS), model, sent=_sent)
    kept = found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_CERTAINTY))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents: that with the smallest id, documents without an id after all others.

    A row is known by two hashes of its id and text, so documents without an id, and several texts with one id, leave with their group.
    """
    _free()
    keys = {"key_1": F.xxhash64("doc_id", "text"), "key_2": F.xxhash64(F.lit(1), "doc_id", "text")}
    keyed = docs.select(*COLUMNS).withColumns(keys)
    groups = ngram_join.link_components(keyed, carried=tuple(keys))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *keys)).alias("first")
    kept = groups.filter("group is not null").groupBy("group").agg(first).select("first.key_1", "first.key_2")
    bare = groups.filter("group is null").select(*keys)
    return keyed.join(kept.unionByName(bare).distinct(), list(keys), "left_semi").dropDuplicates(list(keys)).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    _free()
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; ``n_chars`` follows the text."""
    _free()
    clean = secrets.prepared(docs, *COLUMNS)
    found = secrets.scan(clean, secrets.train(clean.select("clean")))
    text = secrets.redacted(F.col("text"), F.col("found"))
    changed = found.withColumn("text", text)
    length = F.when(F.size("found") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")
    return changed.withColumn("n_chars", length).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    _free()
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Language, secrets and packing are trained models and a linear program: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
