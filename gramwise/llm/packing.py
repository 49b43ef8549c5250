"""Sequence packing as a cutting-stock problem solved by column generation.

A document's tokens fill whole sequences first; the rest, shorter than a sequence, is packed uncut.  Rests are counted in
length classes (a histogram of fixed size), and a linear program over patterns of classes chooses how many sequences of
each pattern to build: a knapsack recursion prices new patterns until none lowers the number of sequences.  Rounded-down
pattern counts take most rests; the few that remain are packed best-fit on the histogram.  Documents are ranked within their
class, by counts per bucket and ranks inside buckets, and a rank names the slot.

Defined results: null or empty text is the end token alone; ties and repeated rows are ranked in a fixed order and
each is packed; a null id is packed like any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramwise.llm.common import table, written

#: Rows of a bucket in which documents are ranked.
BUCKET_ROWS = 20_000


# --- tokens -------------------------------------------------------------------------------------------------------


#: Byte-level tokenizers write the bytes without a printable character as the characters from 256 on, in order.
_HIDDEN = [*range(33), *range(127, 161), 173]
_SHOWN = {byte: 256 + i for i, byte in enumerate(_HIDDEN)}


#: Texts of these characters only: ASCII, and Latin letters and signs that stay single characters in lower case.
_COMMON = re.compile("[\t\n\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u024f\u2010-\u2027]*")
_LETTER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
#: The tokenizer's own pattern for texts of these characters.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")


class CachedTokenizer:
    """Ids of whole texts, piece by piece: equal pieces have equal ids, which are kept in a table of bounded size.

    Texts with other than common Latin characters, or with the start of a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str, entries: int = 300_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._entries = entries
        self._pieces: dict[str, bytes] = {}

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if not _COMMON.fullmatch(text) or "<|" in text:
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        known, found = self._pieces, _PIECE.findall(text.lower())
        try:
            return b"".join(map(known.get, found))
        except TypeError:  # a piece that is not in the table
            pass
        if len(known) + len(found) > self._entries:
            known.clear()
        for piece in found:
            if piece not in known:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
                known[piece] = array("I", [x.id for x in self._model.tokenize(shown)]).tobytes()
        return b"".join(map(known.__getitem__, found))


def tokenized(docs: DataFrame, tokenizer: str, length: int, end_id: int = 1) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens`` of at most ``length`` ids; the last of a document is its rest."""

    def cut(batches):
        ids_of = CachedTokenizer(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = ids_of(text.as_py()) + end
                n = len(ids) // 4
                rows += [(doc_id, at, min(length, n - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), n) for at in range(0, n, length)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


# --- patterns -----------------------------------------------------------------------------------------------------


def _price(worth: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: knapsack over capacities, any number of pieces of a class."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    size, worth = size[order], worth[order]
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(size, room, "right"))
        value = best[room - size[:fits]] + worth[:fits]
        k = int(value.argmax()) if fits else -1
        if k >= 0 and value[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = value[k], k
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(size), np.int64), capacity
    while room > 0:
        k = choice[room]
        if k < 0:
            room -= 1
        else:
            pattern[order[k]] += 1
            room -= size[k]
    return float(best[capacity]), pattern


def cutting_plan(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that every class is met exactly.

    Column generation with the basis kept as an inverse matrix; ``rounds`` bounds the pivots, and any basis on the way is
    a valid plan.  The rest after rounding down is packed best-fit, largest first.
    """
    m = len(size)
    if not m:
        return []
    per = capacity // size
    basis = np.diag(per).astype(float)
    inverse = np.diag(1.0 / per)
    use = demand / per
    for _ in range(rounds):
        value, column = _price(inverse.sum(0), size, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    plan, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-use, kind="stable"):
        column = basis[:, j].astype(np.int64)
        times = int(use[j] + 1e-6)
        if column.any():
            times = min(times, int((left[column > 0] // column[column > 0]).min()))
            if times > 0:
                plan.append((column, times))
                left -= times * column
    return plan + _best_fit(size, left, capacity)


def _best_fit(size: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Fills one pattern after another with the largest pieces that fit, as often as the pieces last."""
    left, plan = left.copy(), []
    order = np.argsort(-size, kind="stable")
    while left.any():
        pattern, room = np.zeros(len(size), np.int64), capacity
        for k in order:
            take = min(int(left[k]), room // int(size[k]))
            pattern[k], room = take, room - take * int(size[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


@dataclass(frozen=True)
class Slots:
    """Where the pieces of one class go: by rank, the pattern, its copy and the place in it."""

    ends: np.ndarray
    per: np.ndarray
    first: np.ndarray


def slots(plan: list[tuple[np.ndarray, int]], classes: int) -> list[Slots]:
    starts = np.cumsum([0, *(times for _, times in plan)])
    out = []
    for k in range(classes):
        used = [i for i, (pattern, _) in enumerate(plan) if pattern[k]]
        per = np.array([plan[i][0][k] for i in used], np.int64)
        times = np.array([plan[i][1] for i in used], np.int64)
        out.append(Slots(np.cumsum(per * times), per, starts[used]))
    return out


# --- assignment ---------------------------------------------------------------------------------------------------


def _ranked(rows: DataFrame) -> DataFrame:
    """``rank`` of each piece in its class from 0: pieces of earlier buckets, then the rank within the bucket."""
    sizes = rows.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    within = rows.withColumn("within", F.row_number().over(inside) - 1)
    return within.join(offsets, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("within")).drop("before", "within")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, unit: int = 8, end_id: int = 1) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; classes are lengths rounded up to multiples of ``unit``."""
    capacity = length // unit
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = written(
        tokenized(docs, tokenizer, length, end_id).withColumn("class", F.ceil(F.col("length") / unit).cast("int")), "pieces"
    )
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    size = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[k] for k in sorted(histogram)], np.int64)
    where = slots(cutting_plan(size, demand, capacity), len(size))
    shared = docs.sparkSession.sparkContext.broadcast({int(k): (s.ends, s.per, s.first) for k, s in zip(size, where, strict=True)})
    buckets = max(1, -(-int(demand.sum()) // BUCKET_ROWS))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))

    def place(batches):
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(kind):
                ends, per, first = shared.value[int(k)]
                at = np.flatnonzero(kind == k)
                pattern = np.searchsorted(ends, rank[at], "right")
                inside = rank[at] - (ends[pattern] - np.diff(ends, prepend=0)[pattern])
                sequence[at], place[at] = first[pattern] + inside // per[pattern], inside % per[pattern]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(place)], names=[*names, "sequence_id", "place"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
    schema = ", ".join(f"{c} {'int' if c == 'class' else 'bigint'}" for c in [*names, "sequence_id", "place"])
    placed = _ranked(bucketed).select(*names, "rank").mapInArrow(place, schema)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "place").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
