"""Prediction by partial matching over bytes.

A trie of contexts of up to ``order`` bytes is counted over all training texts.  The chance of a byte is its count in the longest
context known, less a half; a byte that was not seen there costs an escape, whose chance is made of those halves, and is then
looked for in the context one byte shorter, with the bytes of the longer one excluded from the counts.  Bytes never seen share what is left.  Text is framed by the byte 0xFF, which UTF-8 never uses, so that the first
bytes and the end are predicted too.

Counts cover every training text, and no entry of the trie is dropped.  It lies in parts by the last ``WHOLE`` bytes of the
context; shorter grams are needed by all parts and travel to each.  The chances of the ``nodes`` most frequent grams travel to
the texts: the least count that a gram needs is read from a histogram.  All other grams of the texts are sent to their part, scored
against its whole trie, and summed by text.  Word counts for the base score work alike: the most frequent words travel, and all
others are looked up by a join.

Defined results: null text is empty and scores its end; a null id counts as training; repeated rows train and are scored
as often as they come; without training rows every byte is one of 256; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from gramwise.llm.common import _LOWER, is_held_out, mix, pieces, prefix_hashes, run_hashes, table, text_bytes, word_spans, written
from gramwise.llm.tally import BLOCK_SCHEMA, Tally, block, merged, unpacked

FRAME = 0xFF
#: Kinds of blocks: words by hash, grams by their number of bytes, and grams asked for.
WORDS, ASKED = 0, 100
#: Grams of up to so many bytes are sent whole; longer ones lie in parts by as many last bytes of their context.
WHOLE = 3
#: Escape estimation: what each distinct byte of a context gives up of its count.
DISCOUNT = 0.5
#: Bytes of text scored at once, beside the trie.
SCORED_BYTES = 1 << 18


def framed(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts with ``order`` frame bytes before and one after each; and where the first predicted byte of each lies."""
    n = len(offsets) - 1
    out = np.full(len(data) + n * (order + 1), FRAME, np.uint8)
    shift = order + (order + 1) * np.arange(n)
    out[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
    return out, offsets[:-1] + shift


def grams(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """For each predicted byte, it and the ``order`` bytes before it as one number, the byte itself lowest."""
    keys = np.zeros(len(data) - order, np.uint64)
    for k in range(order, -1, -1):
        keys <<= np.uint64(8)
        keys |= data[order - k : len(data) - k]
    ends = lengths + 1
    at = np.repeat(first - order - np.cumsum(ends) + ends, ends) + np.arange(int(ends.sum()))
    return keys[at]


def _low(keys: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes."""
    return keys & np.uint64((1 << (8 * size)) - 1)


def _part_of_gram(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the last bytes of the context, so that a part holds every context it needs with all its bytes."""
    return (mix(_low(keys >> np.uint64(8), WHOLE)) % np.uint64(parts)).astype(np.int64)


def _shortened(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the grams' last ``size`` bytes."""
    tally = Tally()
    tally.add(_low(keys, size), counts)
    tally.merge()
    return tally.keys, tally.counts


def _counted(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """Blocks of counts: words by hash, and grams of the highest order, of which all shorter ones follow."""

    def count(batches):
        words, found = Tally(), Tally()
        by_word, by_gram = (lambda k: (k % np.uint64(parts)).astype(np.int64)), (lambda k: _part_of_gram(k, parts))
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in pieces(offsets):
                part, bounds = _LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
                starts, ends, _ = word_spans(part, bounds)
                words.add(run_hashes(prefix_hashes(part), starts, ends))
                found.add(grams(*framed(part, bounds, order), np.diff(bounds), order))
                for tally, kind, by in ((words, WORDS, by_word), (found, order + 1, by_gram)):
                    if len(tally.keys) > 1 << 20:
                        yield from tally.blocks(kind, by)
        yield from words.blocks(WORDS, by_word)
        yield from found.blocks(order + 1, by_gram)

    return merged(docs.select("text").mapInArrow(count, BLOCK_SCHEMA))


def _whole(blocks: DataFrame, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The counts of all grams that are needed by every part: ``{size: (sorted grams, counts)}``."""

    def short(batches):
        for batch in batches:
            for _, _, keys, counts in unpacked(batch):
                for size in range(min(order + 1, WHOLE), 0, -1):
                    keys, counts = _shortened(keys, counts, size)
                    yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(keys), size, np.int32)), "gram": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    rows = blocks.mapInArrow(short, "size int, gram bigint, n bigint").groupBy("size", "gram").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for size, found in rows.groupby("size"):
        found = found.sort_values("gram")
        out[int(size)] = found["gram"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    return out


def _seen_logs(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The log of the chance of each gram that was counted, from all grams of its context."""
    first = np.flatnonzero(np.diff(keys >> np.uint64(8), prepend=~(keys[:1] >> np.uint64(8))))
    total = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys))))
    return np.log10(counts - DISCOUNT) - np.log10(total)


def _frequent(blocks: DataFrame, most: int, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys with the largest counts, at most ``most`` of them, and the value of each; a value is made from the whole block."""

    def histogram(batches):
        total = np.zeros(1 << 12, np.int64)
        for batch in batches:
            for _, _, _, counts in unpacked(batch):
                total += np.bincount(_step(counts), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"step": pa.array(range(len(total)), pa.int32()), "n": pa.array(total)})

    rows = blocks.mapInArrow(histogram, "step int, n bigint").filter("n > 0").groupBy("step").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(1 << 12, np.int64)
    for row in rows:
        total[row["step"]] = row["n"]
    above = np.cumsum(total[::-1])[::-1]
    least = int(np.flatnonzero(above <= most)[0])

    def pick(batches):
        for batch in batches:
            for kind, part, keys, counts in unpacked(batch):
                keep = _step(counts) >= least
                if keep.any():
                    yield block(kind, part, keys[keep], value(keys, counts)[keep].astype("<f8").view("<i8"))

    found = blocks.mapInArrow(pick, BLOCK_SCHEMA).collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(row["keys"], "<u8") for row in found)])
    return keys, np.concatenate([np.zeros(0), *(np.frombuffer(row["counts"], "<f8") for row in found)])


def _asked(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks of the grams of ``rows(row, grams)``, with the row of each in place of a count."""

    def ask(batches):
        for batch in batches:
            column = batch.column("grams")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            keys = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), lengths)
            for low in range(0, len(keys), 1 << 20):
                part = _part_of_gram(keys[low : low + (1 << 20)], parts)
                by = np.argsort(part, kind="stable")
                starts = np.flatnonzero(np.diff(part[by], prepend=-1)).tolist()
                for start, end in zip(starts, [*starts[1:], len(by)], strict=True):
                    at = by[start:end]
                    yield block(ASKED, int(part[at[0]]), keys[low + at], of[low + at])

    return rows.select("row", "grams").mapInArrow(ask, BLOCK_SCHEMA)


def _answers(blocks: DataFrame, asked: DataFrame, whole: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> DataFrame:
    """``row, gram_log``: sums of the logs of the grams asked for, each from the whole trie of its part; several for each row."""
    shared = blocks.sparkSession.sparkContext.broadcast(whole)

    def answer(batches):
        now, model = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                for kind, part, keys, counts in unpacked(batch.slice(i, 1)):
                    if part != now:
                        now, model, entries = part, None, dict(shared.value)
                    if kind != ASKED:
                        # The only block of counts comes first.
                        for size in range(order + 1, WHOLE, -1):
                            keys, counts = _shortened(keys, counts, size)
                            entries[size] = keys, counts
                        continue
                    model = model or ByteModel.of(entries, order)
                    distinct, at = np.unique(keys, return_inverse=True)
                    rows, where = np.unique(counts, return_inverse=True)
                    sums = np.bincount(where, model.log10(distinct)[at])
                    yield pa.RecordBatch.from_pydict({"row": pa.array(rows.astype(np.int64)), "gram_log": pa.array(sums)})

    both = blocks.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(answer, "row bigint, gram_log double")


def _step(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale that is exact up to 64 and then has 64 steps for each doubling."""
    counts = counts.astype(float)
    return np.where(counts < 64, counts, 64 * (np.log2(np.maximum(counts, 64)) - 5)).astype(np.int64)


def hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing: slots with keys and, in them, the position of the key; empty slots hold -1."""
    size = 1 << max(4, (3 * len(keys) // 2).bit_length())
    slot_key, slot_at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
    left = np.arange(len(keys))
    slot = (mix(keys) & np.uint64(size - 1)).astype(np.int64)
    while len(left):
        free = slot_at[slot[left]] < 0
        claim = left[free]
        slot_at[slot[claim]] = claim
        won = np.zeros(len(keys), bool)
        won[claim[slot_at[slot[claim]] == claim]] = True
        slot_key[slot[won]] = keys[won]
        left = left[~won[left]]
        slot[left] = (slot[left] + 1) & (size - 1)
    return slot_key, slot_at


def look_up(slots: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The position of each key, -1 where it is not in the table."""
    slot_key, slot_at = slots
    mask = len(slot_key) - 1
    slot = (mix(keys) & np.uint64(mask)).astype(np.int64)
    out = slot_at[slot]
    wrong = np.flatnonzero((out >= 0) & (slot_key[slot] != keys))
    while len(wrong):
        slot[wrong] = (slot[wrong] + 1) & mask
        out[wrong] = slot_at[slot[wrong]]
        wrong = wrong[(out[wrong] >= 0) & (slot_key[slot[wrong]] != keys[wrong])]
    return out


@dataclass(frozen=True)
class ByteModel:
    """Entries of all orders and contexts of all sizes in two tables; keys carry the size in their top byte."""

    order: int
    gram_slots: tuple[np.ndarray, np.ndarray]
    gram_log: np.ndarray
    context_slots: tuple[np.ndarray, np.ndarray]
    #: By context: log of all its counts, of its escape; the same in its shorter context, without its own bytes.
    context_logs: np.ndarray
    unseen_log: float

    @staticmethod
    def of(entries: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> ByteModel:
        """From ``{size: (sorted grams of that many bytes, counts)}``."""
        keys, logs, contexts, context_logs = [], [], [], []
        unseen, below = 256, None
        for size in range(1, order + 2):
            gram, count = entries.get(size, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            context = gram >> np.uint64(8)
            first = np.flatnonzero(np.diff(context, prepend=~context[:1]))
            context = context[first]
            seen = np.add.reduceat(count, first) if len(first) else count
            kinds = np.diff(np.append(first, len(gram)))
            total = seen.copy()
            if size == 1:
                unseen -= len(gram)
                excluded_total, excluded_escape = total, np.zeros(len(first))
            else:
                shorter_gram, shorter_count, shorter_context, shorter_seen, shorter_total, shorter_kinds = below
                # A context's own count is that of the gram with the same bytes.
                at = np.minimum(np.searchsorted(shorter_gram, context), max(len(shorter_gram) - 1, 0))
                if len(shorter_gram):
                    total = np.where(shorter_gram[at] == context, np.maximum(seen, shorter_count[at]), seen)
                parent = np.searchsorted(shorter_context, _low(context, size - 2))
                inside = shorter_count[np.searchsorted(shorter_gram, _low(gram, size - 1))] if len(gram) else count
                inside = np.add.reduceat(inside, first) if len(first) else inside
                new = shorter_kinds[parent] - kinds
                excluded_escape = shorter_total[parent] - shorter_seen[parent] + DISCOUNT * new
                excluded_total = shorter_total[parent] - inside
            with np.errstate(divide="ignore"):
                plain = np.log10(total), np.log10(total - seen + DISCOUNT * kinds)
                less = np.log10(excluded_total), np.log10(excluded_escape)
                less = tuple(np.where(excluded_escape + excluded_total > 0, x, 0.0) for x in less)
            contexts.append(context | np.uint64(size << 56))
            context_logs.append(np.stack([*plain, *less], 1))
            keys.append(gram | np.uint64(size << 56))
            logs.append(np.log10(count - DISCOUNT))
            below = gram, count, context, seen, total, kinds
        return ByteModel(
            order,
            hash_table(np.concatenate(keys)),
            np.concatenate(logs).astype(np.float32),
            hash_table(np.concatenate(contexts)),
            np.concatenate(context_logs).astype(np.float32),
            -float(np.log10(max(unseen, 1))),
        )

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log of the chance of each predicted byte, given ``grams`` of the highest order."""
        if not len(self.context_logs):
            return np.full(len(keys), self.unseen_log)
        out = np.zeros(len(keys))
        open_, above = np.arange(len(keys)), np.full(len(keys), -1, np.int32)
        for size in range(self.order + 1, 0, -1):
            now = _low(keys, size)
            mark = np.uint64(size << 56)
            hit = look_up(self.gram_slots, now | mark)
            context = look_up(self.context_slots, (now >> np.uint64(8)) | mark)
            # Counts as they are, or, below a context that was escaped from, without that context's bytes.
            total = np.where(above >= 0, self.context_logs[above, 2], self.context_logs[context, 0])
            found = hit >= 0
            out[open_[found]] += self.gram_log[hit[found]] - total[found]
            rest = np.flatnonzero(~found)
            known = rest[context[rest] >= 0]
            escape = np.where(above[known] >= 0, self.context_logs[above[known], 3], self.context_logs[context[known], 1])
            out[open_[known]] += escape - total[known]
            open_, keys, above = open_[rest], keys[rest], context[rest]
        out[open_] += self.unseen_log
        return out


def score(docs: DataFrame, training: DataFrame, order: int = 6, nodes: int = 1 << 20, words: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``n_tokens, n_known, train_tokens, base_score, score``, learned from ``training(text)``.

    ``nodes`` and ``words`` bound what travels to executors; rarer grams and words are joined, so both scores are exact.
    ``parts`` is the number of parts in which counts are merged, by default as the root of the number of texts.
    """
    columns = [c for c in docs.columns if c != "text"]
    spark = docs.sparkSession
    texts = training.count()
    # Distinct grams grow more slowly than the texts.
    parts = parts or 256 * max(1, round((texts / 1e6) ** 0.5))
    blocks = written(_counted(training, order, parts), "counts")
    kinds = blocks.filter(f"kind = {WORDS}")

    def exploded(batches):
        for batch in batches:
            for _, _, keys, counts in unpacked(batch):
                yield pa.RecordBatch.from_pydict({"word": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    counts = kinds.mapInArrow(exploded, "word bigint, n bigint")
    size = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tokens, vocabulary = size["n"] + texts, size["v"] + (texts > 0)
    log_all = float(np.log10(tokens + vocabulary + 1))
    tries = blocks.filter(f"kind > {WORDS}")
    grams_sent = _frequent(tries, nodes, _seen_logs)
    words_sent = _frequent(kinds, words, lambda _, n: np.log10(n + 1.0))
    shared = spark.sparkContext.broadcast((hash_table(grams_sent[0]), grams_sent[1], hash_table(words_sent[0]), words_sent[1]))
    end_log = float(np.log10(texts + 1.0))

    def one(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in pieces(offsets, SCORED_BYTES):
                part, bounds = _LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
                yield scored(batch.slice(low, high - low), part, bounds)

    def found_in(slots, logs, keys, first):
        """By text: the sum and the number of what was sent; and the keys that were not."""
        at = look_up(slots, keys)
        rare = at < 0
        sums = np.concatenate([[0.0], np.cumsum(np.where(rare, 0.0, logs[at] if len(logs) else 0.0))])
        seen = np.concatenate([[0], np.cumsum(~rare)])
        bounds = (np.arange(len(keys) + 1) - seen)[first].astype(np.int32)
        return np.diff(sums[first]), np.diff(seen[first]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[rare].view(np.int64)))

    def scored(rows, part, bounds):
        gram_slots, gram_log, word_slots, word_log = shared.value
        lengths = np.diff(bounds) + 1
        gram = grams(*framed(part, bounds, order), lengths - 1, order)
        chance, _, rare_grams = found_in(gram_slots, gram_log, gram, np.concatenate([[0], np.cumsum(lengths)]))
        starts, ends, first = word_spans(part, bounds)
        word = run_hashes(prefix_hashes(part), starts, ends)
        base, seen, rare = found_in(word_slots, word_log, word, first)
        result = {
            "n_tokens": pa.array(np.diff(first) + 1),
            "known": pa.array(seen + int(texts > 0)),
            "base": pa.array(base + end_log),
            "score": pa.array(chance),
            "rare": rare,
            "grams": rare_grams,
        }
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *result.values()], names=[*columns, *result])

    schema = docs.select(columns).schema
    for name, kind in (("n_tokens", LongType()), ("known", LongType()), ("base", DoubleType()), ("score", DoubleType()), ("rare", ArrayType(LongType())), ("grams", ArrayType(LongType()))):
        schema = schema.add(name, kind)
    rows = written(docs.select(*columns, "text").mapInArrow(one, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = rows.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.select("row", F.log10(F.coalesce("n", F.lit(0)) + 1.0).alias("rare_log"), F.col("n").isNotNull().cast("int").alias("rare_known"))
    looked_up = rare.unionByName(_answers(tries, _asked(rows, parts), _whole(tries, order), order), allowMissingColumns=True)
    looked_up = looked_up.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("rare_log", "rare_known", "gram_log")))
    out = rows.join(looked_up, "row", "left")
    return out.select(
        *columns,
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("score") + F.coalesce("gram_log", F.lit(0.0))).alias("score"),
    )


def op1_ppm(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a byte model of order six, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = is_held_out("doc_id", 7, 2)
    return score(docs.select("doc_id", held.alias("held_out"), "text"), docs.filter(~held).select("text"))
