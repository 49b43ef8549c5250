"""Benchmark passages in documents, within an edit distance of words.

Words are runs of letters, digits and non-ASCII bytes, ASCII letters in lower case.  An item of n words and k allowed edits has a run
of (n - k) / (k + 1) words that no edit touches, so windows of the item's size are taken only where a document has such a run
of an item, aligned by it: this loses nothing.  CGK random walks embed window and item so that edits become Hamming
distance, and a window is a candidate when all sampled positions of any repetition agree.  The number of repetitions is
measured on edited copies of the items, to reach the target recall.  Candidates are verified by exact edit distance to
any stretch of the document around the window.

Defined results: null or empty texts and items match nothing; repeated rows are each reported; equal items are each
reported; a null id is reported as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.llm.common import _LOWER, mix, pieces, prefix_hashes, run_hashes, table, text_bytes, word_spans

EDITS = 0.2
#: Words of a run by which windows are found, at most.
RUN = 4
#: Items, and bytes of their texts, that travel at once.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Bytes of text that are searched at once, or one document: each byte takes some forty meanwhile.
TEXT_BYTES = 1 << 20
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_ALLOWED = 1e-9


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of all texts, and the first word of each text."""
    low = _LOWER[data]
    starts, ends, first = word_spans(low, offsets, _SEPARATOR)
    return run_hashes(prefix_hashes(low), starts, ends), starts, ends, first


def run_keys(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    if len(words) < size:
        return words[:0]
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out + words[k : len(words) - size + 1 + k])
    return out


def walk(rows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """CGK: a pointer through each row that stays or moves on by a random bit of step and word; 3 steps per word."""
    n, width = rows.shape
    padded = np.concatenate([rows, np.zeros((n, 1), np.uint64)], 1)
    at, every = np.zeros(n, np.int64), np.arange(n)
    out = np.zeros((n, 3 * width), np.uint64)
    for step in range(3 * width):
        word = np.where(at < sizes, padded[every, np.minimum(at, width)], np.uint64(0))
        out[:, step] = word
        at += (mix(word + np.uint64(seed * 1_000_003 + step * 2 + 1)) & np.uint64(1)).astype(np.int64)
    return out


def stretch_distance(items: np.ndarray, sizes: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """The least edit distance of each item to any stretch of its segment; 0 words are padding of segments."""
    n, width = segments.shape
    row = np.zeros((n, width + 1), np.int32)
    out = np.zeros(n, np.int32)
    column = np.arange(width + 1, dtype=np.int32)
    for i in range(items.shape[1]):
        same = segments == items[:, i : i + 1]
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + ~same)
        row = np.minimum.accumulate(new - column, 1) + column
        done = sizes == i + 1
        out[done] = row[done].min(1)
    return out


@dataclass(frozen=True)
class Items:
    """Items as padded rows of words, their runs by hash, and their walks at the sampled steps."""

    ids: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    edits: np.ndarray
    run_sizes: np.ndarray
    #: By run size: sorted hashes with the item and the offset of each.
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: Steps sampled, as shares of the walk: walks x repetitions x samples.
    samples: np.ndarray
    sampled: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[str | None], edits: float, recall: float, walks: int = 4, repeats: int = 16, samples: int = 3) -> Items:
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        hashes, _, _, first = words_of(data, offsets)
        sizes = np.diff(first)
        keep = np.flatnonzero(sizes)
        sizes, width = sizes[keep], int(sizes.max(initial=0))
        words = np.zeros((len(keep), width), np.uint64)
        for row, i in enumerate(keep):
            words[row, : sizes[row]] = hashes[first[i] : first[i + 1]]
        allowed = np.floor(edits * sizes + _ALLOWED).astype(np.int64)
        run_sizes = np.clip((sizes - allowed) // (allowed + 1), 1, RUN)
        runs = {}
        for size in np.unique(run_sizes).tolist():
            rows = np.flatnonzero(run_sizes == size)
            found = [run_keys(words[r, : sizes[r]], size) for r in rows]
            key = np.concatenate(found)
            item = np.repeat(rows, [len(x) for x in found])
            at = np.concatenate([np.arange(len(x)) for x in found])
            order = np.argsort(key, kind="stable")
            runs[size] = key[order], item[order], at[order]
        rng = np.random.Generator(np.random.PCG64(20260103))
        shares = rng.random((walks, repeats, samples))
        made = Items(np.array(ids, object)[keep], words, sizes, allowed, run_sizes, runs, shares, np.zeros(0))
        made = made._replace(samples=shares, sampled=made._sampled(words, sizes))
        return made.calibrated(recall, rng) if len(keep) else made

    def _replace(self, **changes) -> Items:
        return Items(**(vars(self) | changes))

    def _sampled(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The walks of rows at the sampled steps: rows x walks x repetitions x samples."""
        out = np.zeros((len(rows), *self.samples.shape), np.uint64)
        for k, shares in enumerate(self.samples):
            steps = (shares[None] * (3 * sizes)[:, None, None]).astype(np.int64)
            path = walk(rows, sizes, k)
            out[:, k] = np.take_along_axis(path, steps.reshape(len(rows), shares.size), 1).reshape(steps.shape)
        return out

    def repetitions(self, item: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each window whether each repetition agrees with its item in all samples: windows x walks x repetitions."""
        return (self._sampled(rows, self.sizes[item]) == self.sampled[item]).all(-1)

    def calibrated(self, recall: float, rng: np.random.Generator, copies: int = 2, most: int = 200) -> Items:
        """With as many walks and repetitions as edited copies of at most ``most`` items need to be found."""
        documents, rows = [], []
        for row in rng.permutation(len(self.sizes))[:most]:
            for _ in range(copies):
                text = list(self.words[row, : self.sizes[row]])
                for _ in range(int(self.edits[row])):
                    kind, at = rng.integers(3), int(rng.integers(max(len(text), 1)))
                    fresh = rng.integers(1, 2**63, dtype=np.uint64)
                    if kind == 0:
                        text.insert(at, fresh)
                    elif kind == 1 and text:
                        text[at] = fresh
                    elif text:
                        del text[at]
                around = rng.integers(1, 2**63, (2, self.words.shape[1]), dtype=np.uint64)
                documents.append(np.concatenate([around[0], np.array(text, np.uint64), around[1]]))
                rows.append(row)
        first = np.cumsum([0, *map(len, documents)])
        words = np.concatenate(documents)
        item, start, text = self.windows(words, first)
        own = item == np.array(rows)[text]
        item, start, text = item[own], start[own], text[own]
        if not len(item):
            return self
        agreed = self.repetitions(item, _cut(words, start, self.words.shape[1], first[text], first[text + 1]))
        found = np.zeros((len(rows), *self.samples.shape[:2]), bool)
        np.logical_or.at(found, text, agreed)
        found = found[np.unique(text)]
        for count in range(1, self.samples.shape[1] + 1):
            if found[:, :, :count].any((1, 2)).mean() >= recall:
                break
        samples = self.samples[:, :count]
        return self._replace(samples=samples, sampled=self._replace(samples=samples)._sampled(self.words, self.sizes))

    def windows(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, first word and text of each window that shares a run with the item; ``first`` gives the texts' first words."""
        items, starts, texts = [], [], []
        for size, (key, item, at) in self.runs.items():
            found = run_keys(words, size)
            low = np.searchsorted(key, found)
            place = np.flatnonzero(key[np.minimum(low, len(key) - 1)] == found) if len(found) else low
            text = np.searchsorted(first, place, "right") - 1
            inside = place + size <= first[text + 1] if len(place) else np.zeros(0, bool)
            place, text, low = place[inside], text[inside], low[place[inside]]
            count = np.searchsorted(key, found[place], "right") - low
            index = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            items.append(item[index])
            starts.append(np.repeat(place, count) - at[index])
            texts.append(np.repeat(text, count))
        item, start, text = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (items, starts, texts))
        _, once = np.unique(np.stack([text, item, start]), axis=1, return_index=True)
        return item[once], start[once], text[once]

    def leaks(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, item, first word of the window and edits of every verified window."""
        item, start, text = self.windows(words, first)
        found = []
        for low in range(0, len(item), 4096):
            i, s, t = item[low : low + 4096], start[low : low + 4096], text[low : low + 4096]
            width = int(self.sizes[i].max())
            near = self.repetitions(i, _cut(words, s, self.words.shape[1], first[t], first[t + 1])).any((1, 2))
            i, s, t = i[near], s[near], t[near]
            if len(i):
                slack = int(self.edits[i].max())
                segments = _cut(words, s - slack, width + 2 * slack, first[t], first[t + 1])
                distance = stretch_distance(self.words[i], self.sizes[i], segments)
                good = distance <= self.edits[i]
                found.append((t[good], i[good], np.maximum(s[good], first[t[good]]), distance[good]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _cut(words: np.ndarray, start: np.ndarray, width: int, low, high) -> np.ndarray:
    """Rows of ``width`` words from each start; 0 outside the text's own words."""
    at = start[:, None] + np.arange(width)
    low, high = np.broadcast_to(low, start.shape)[:, None], np.broadcast_to(high, start.shape)[:, None]
    return np.where((at >= low) & (at < high), words[np.clip(at, 0, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else np.zeros(at.shape, np.uint64)


def leaked(docs: DataFrame, items: DataFrame, edits: float = EDITS, recall: float = 0.99, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, start, stop, edits``: for each document and item the passage with the fewest edits.

    ``docs(doc_id, text)``, ``items(item_id, text)``.  Items go to the executors in blocks of bounded size, one pass over
    the documents each; offsets are bytes of the item-sized window.
    """
    out = None
    for block in _blocks(items, edits, recall, block_items):
        found = _searched(docs, block)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, edits: float = EDITS, recall: float = 0.99, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs(text, ...)`` in which no item is found."""

    def kept(batches):
        known = Items(**shared.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            clean = np.ones(batch.num_rows, bool)
            for low, high in pieces(offsets, TEXT_BYTES):
                words, _, _, first = words_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                clean[low + known.leaks(words, first)[0]] = False
            yield batch.filter(pa.array(clean))

    for block in _blocks(items, edits, recall, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(vars(block))
        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def _blocks(items: DataFrame, edits: float, recall: float, block_items: int) -> Iterator[Items]:
    """All items, a bounded number of them at a time."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["bytes"] // BLOCK_BYTES))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = part.select("item_id", "text").orderBy("item_id", "text").collect()
        yield Items.of([r["item_id"] for r in rows], [r["text"] for r in rows], edits, recall)


def _searched(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(items))

    def search(batches):
        known = Items(**shared.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in pieces(offsets, TEXT_BYTES):
                words, starts, ends, first = words_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                text, item, start, distance = known.leaks(words, first)
                if not len(text):
                    continue
                order = np.lexsort((start, distance, item, text))
                best = order[np.flatnonzero(np.diff(text[order] * (len(known.sizes) + 1) + item[order], prepend=-1))]
                text, item, start, distance = text[best], item[best], start[best], distance[best]
                stop = np.minimum(start + known.sizes[item], first[text + 1]) - 1
                base = offsets[low + text] - offsets[low]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(text + low)),
                        "item_id": pa.array(known.ids[item].tolist(), pa.int64()),
                        "start": pa.array(starts[start] - base),
                        "stop": pa.array(ends[stop] - base),
                        "edits": pa.array(distance.astype(np.int64)),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(search, "doc_id bigint, item_id bigint, start bigint, stop bigint, edits bigint")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
