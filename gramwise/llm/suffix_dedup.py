"""Removal of repeated byte strings, by bucket-pointer refinement.

Every window of ``length`` bytes is assigned to an anchor inside it: the least of its q-grams by hash, the leftmost of equal
ones.  Equal windows have equal anchors, so the windows of one anchor need comparing only with those of anchors with the
same q-gram: the initial buckets.  A bucket whose windows all come from equal surroundings is settled by counting.  For the
others one copy of each surrounding text is gathered, and the positions in it are sorted by refinement: buckets of
8-grams are split by the bucket numbers ``h`` bytes later, the depth doubling up to the window's length; positions alone
in their bucket leave, and their numbers split others at once.  Very large buckets are refined in the same way by a
shuffle of the windows' own numbers instead, so that no task holds them.

Defined results: null and empty text has no bytes; documents shorter than a window lose nothing; repeated rows are other
places of the same strings, so all of their windows go; a null id is like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.llm.common import _BASE_INVERSE, in_filter, key_filter, mix, powers, prefix_hashes, run_hashes, table, text_bytes, written

LENGTH = 400
GRAM = 200
#: Surrounding texts of one bucket that a task refines in memory; beyond, windows are shuffled.
BUCKET_TEXTS = 4096
_PIECE = 1 << 20
#: Odd; its product with any offset stays within 64 bits.
_SPREAD = 0x9E3779B1


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of its leftmost least one."""
    n = len(values)
    # Position as the low bits, so that the least number is the leftmost least value.
    size = np.uint64(max(1, (n - 1).bit_length()))
    tagged = (values >> size << size) | np.arange(n, dtype=np.uint64)
    blocks = np.concatenate([tagged, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[: n - width + 1], left[width - 1 : n])
    return (least & ((np.uint64(1) << size) - np.uint64(1))).astype(np.int64)


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Window starts in runs of one anchor each: first and last start, hash of the anchor's gram, hash of all bytes."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums = prefix_hashes(data)
    hashes = (sums[gram:] - sums[:-gram]) * powers(_BASE_INVERSE, len(data))[: len(data) - gram + 1]
    chosen = _leftmost_least(hashes, length - gram + 1)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], len(chosen)) - 1
    # Runs of the same bytes around another place in them are other surroundings.
    whole = run_hashes(sums, first, last + length) ^ mix((chosen[first] - first).astype(np.uint64))
    return first, last, mix(hashes[chosen[first]]), whole


def refined(text: np.ndarray, length: int) -> np.ndarray:
    """Numbers of buckets of positions: equal where the next ``length`` bytes are equal, for all that have so many."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    depth = min(8, length)
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key = key << np.uint64(8) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    opens = np.diff(key[order], prepend=~key[order[:1]]) != 0
    number = np.empty(n + 1, np.int64)
    number[n] = -1
    number[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    shared = np.append(~opens[1:], False) | ~opens
    active = order[shared]
    while depth < length and len(active):
        step = min(depth, length - depth)
        later = number[np.minimum(active + step, n)]
        bucket = number[active]
        rank = np.lexsort((later, bucket))
        active, bucket, later = active[rank], bucket[rank], later[rank]
        new_bucket = np.diff(bucket, prepend=-1) != 0
        opens = new_bucket | (np.diff(later, prepend=-2) != 0)
        # The number of a bucket points to where it starts among the sorted positions.
        start = np.maximum.accumulate(np.where(new_bucket, np.arange(len(active)), 0))
        number[active] = bucket + np.maximum.accumulate(np.where(opens, np.arange(len(active)), 0)) - start
        active = active[np.append(~opens[1:], False) | ~opens]
        depth += step
    return number[:n]


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of windows that also stand elsewhere in the texts."""
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    number = refined(np.frombuffer(b"".join(texts), np.uint8), length)
    whole = np.concatenate([np.arange(b - a, b - length + 1) for a, b in zip(sizes, ends, strict=True)])
    _, back, count = np.unique(number[whole], return_inverse=True, return_counts=True)
    marks = np.zeros(len(number), bool)
    marks[whole] = count[back] > 1
    return [np.flatnonzero(marks[b - a : b]) for a, b in zip(sizes, ends, strict=True)]


def _runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans that windows from these starts cover, each run of neighbouring starts one span."""
    gap = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], gap + 1])], starts[np.append(gap, len(starts) - 1)] + length


def _keyed(docs: DataFrame) -> DataFrame:
    """``key`` and ``other``: two hashes of the text, the same whenever the row is read; equal texts have equal spans."""
    other = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return docs.withColumn("key", F.xxhash64("text")).withColumn("other", other)


def _distinct(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """One row of each text of a batch, and how many it has."""
    names = np.column_stack([batch.column("key").to_numpy(), batch.column("other").to_numpy()])
    _, first, count = np.unique(names, axis=0, return_index=True, return_counts=True)
    return first, count


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def describe(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys, others, found = batch.column("key").to_numpy(), batch.column("other").to_numpy(), [[] for _ in range(7)]
            # Repeated texts of a batch are described once, with their number.
            for i, rows in zip(*(x.tolist() for x in _distinct(batch)), strict=True):
                if offsets[i + 1] - offsets[i] < length:
                    continue
                first, last, bucket, whole = anchors(data[offsets[i] : offsets[i + 1]], length, gram)
                same = (np.full(len(first), x) for x in (keys[i], others[i], rows))
                for column, values in zip(found, (*same, first, last, bucket.view(np.int64), whole.view(np.int64)), strict=True):
                    column.append(values)
            if found[0]:
                key, other, rows, first, last, bucket, whole = map(np.concatenate, found)
                yield pa.RecordBatch.from_pydict(
                    {"key": key, "other": other, "rows": rows, "first": first.astype(np.int32), "last": last.astype(np.int32), "bucket": bucket, "around": whole}
                )

    return docs.mapInArrow(describe, "key bigint, other bigint, rows bigint, first int, last int, bucket bigint, around bigint")


def _texts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, other, first, text`` of the wanted surroundings ``(key, other, first)``, and by chance a few more."""
    place = F.col("key").bitwiseXOR(F.col("first").cast("bigint") * F.lit(_SPREAD))
    both = key_filter(wanted, "key"), key_filter(wanted.select(place.alias("place")), "place")
    bits = docs.sparkSession.sparkContext.broadcast(both)

    def cut(batches):
        keys_known, places_known = bits.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys, others = batch.column("key").to_numpy(), batch.column("other").to_numpy()
            rows, unlike = [], _distinct(batch)[0]
            for i in unlike[(np.diff(offsets)[unlike] >= length) & in_filter(keys_known, keys[unlike])].tolist():
                text = data[offsets[i] : offsets[i + 1]]
                first, last, _, _ = anchors(text, length, gram)
                for k in np.flatnonzero(in_filter(places_known, keys[i] ^ (first * _SPREAD))).tolist():
                    rows.append((keys[i], others[i], first[k], text[first[k] : last[k] + length].tobytes()))
            if rows:
                key, other, first, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"key": np.array(key, np.int64), "other": np.array(other, np.int64), "first": np.array(first, np.int32), "text": pa.array(texts, pa.binary())}
                )

    return docs.mapInArrow(cut, "key bigint, other bigint, first int, text binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """``key, other, start, stop``: spans of ``docs(key, other, text)`` that repeated windows cover; spans may touch, overlap or come twice."""
    rows = written(_anchor_rows(docs, length, gram), "anchors")
    place = F.struct("key", "other", "first", "last")
    around = rows.groupBy("bucket", "around").agg(F.sum("rows").alias("copies"), F.min(place).alias("place")).select("bucket", "around", "copies", "place.*")
    buckets = around.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("places")).filter("places > 1")
    around = written(around.join(buckets.drop("places"), "bucket"), "around")

    whole = rows.join(around.filter("copies > 1").select("bucket", "around"), ["bucket", "around"])
    spans = whole.select("key", "other", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))

    open_ = around.filter("kinds > 1").select("key", "other", "first", "bucket", "copies", "kinds")
    at = ["key", "other", "first"]
    texts = written(open_.join(_texts(docs, open_.select("key", "first"), length, gram).dropDuplicates(at), at), "texts")

    def settle(rows_):
        found = repeated_starts([x[5] for x in rows_], length)
        out = []
        for (key, other, first, _, copies, _), starts in zip(rows_, found, strict=True):
            # Surroundings that stand in several places are covered already.
            if copies == 1 and len(starts):
                out += [(key, other, first + a, first + b) for a, b in zip(*_runs(starts, length), strict=True)]
        key, other, start, stop = zip(*out, strict=True) if out else ((), (), (), ())
        arrays = [pa.array(key, pa.int64()), pa.array(other, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "other", "start", "stop"])

    columns = ["key", "other", "first", "bucket", "copies", "text"]

    def refine(batches):
        waiting, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if size > _PIECE and row[3] != waiting[-1][3]:
                    yield settle(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[5])
        if waiting:
            yield settle(waiting)

    small = texts.filter(F.col("kinds") <= bucket_texts).select(columns).repartition("bucket").sortWithinPartitions("bucket")
    refined_spans = small.mapInArrow(refine, "key bigint, other bigint, start int, stop int")
    large = texts.filter(F.col("kinds") > bucket_texts).select("key", "other", "first", "copies", "text")
    return spans.unionByName(refined_spans).unionByName(_shuffled(large, length))


def _shuffled(texts: DataFrame, length: int) -> DataFrame:
    """The last refinement by a shuffle: a window's number is made of those of its two halves, 128 bits in all."""

    def windows(batches):
        for batch in batches:
            for key, other, first, copies, text in zip(*(batch.column(c).to_pylist() for c in ("key", "other", "first", "copies", "text")), strict=True):
                sums = prefix_hashes(np.frombuffer(text, np.uint8))
                start = np.arange(len(text) - length + 1)
                half = length // 2
                a, b = run_hashes(sums, start, start + half), run_hashes(sums, start + half, start + length)
                n = len(start)
                same = {"key": np.full(n, key, np.int64), "other": np.full(n, other, np.int64), "copies": np.full(n, copies, np.int64)}
                yield pa.RecordBatch.from_pydict({**same, "start": (first + start).astype(np.int32), "a": a.view(np.int64), "b": b.view(np.int64)})

    rows = texts.mapInArrow(windows, "key bigint, other bigint, copies bigint, start int, a bigint, b bigint")
    several = rows.groupBy("a", "b").agg(F.sum("copies").alias("places")).filter("places > 1").select("a", "b")
    found = rows.filter("copies = 1").join(several, ["a", "b"])
    return found.select("key", "other", "start", (F.col("start") + length).alias("stop"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: the bytes left of ``docs(doc_id, text)``."""
    docs = _keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    spans = repeated_spans(docs.select("key", "other", "text"), length, gram or max(1, length // 2), bucket_texts)
    # Spans of repeated texts come once: no more than one text has.
    by_document = spans.groupBy("key", "other").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            kept, removed, runs = [], [], []
            for i, spans_ in enumerate(batch.column("spans").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                change = np.zeros(len(text) + 1, np.int32)
                for x in spans_ or ():
                    change[x["start"]] += 1
                    change[x["stop"]] -= 1
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(text[~gone].tobytes())
            arrays = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.join(by_document, ["key", "other"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes that strings of 400 bytes repeat."""
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
