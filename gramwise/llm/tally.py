"""Counts of 64-bit keys over a whole table, kept and shuffled as sorted blocks instead of single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_SCHEMA = "kind int, part int, keys binary, counts binary"


class Tally:
    """Counts of keys: sorted distinct keys, merged whenever the unmerged blocks have grown as large as the merged one."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._more: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self._more.append((keys, counts))
        self._size += len(keys)
        if self._size > max(len(self.keys), 1 << 20):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self._more)])
        counts = np.concatenate([self.counts, *(c for _, c in self._more)])
        self._more, self._size = [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        self.keys = keys[first]
        self.counts = np.add.reduceat(counts[order], first) if len(first) else counts

    def blocks(self, kind: int, part_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """What has been counted, one block for each part; the tally is empty afterwards."""
        self.merge()
        if not len(self.keys):
            return
        part = part_of(self.keys)
        order = np.argsort(part, kind="stable")
        keys, counts, part = self.keys[order], self.counts[order], part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
            yield block(kind, int(part[low]), keys[low:high], counts[low:high])
        self.__init__()


def block(kind: int, part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind], pa.int32()),
            pa.array([part], pa.int32()),
            pa.array([keys.astype("<u8").tobytes()], pa.binary()),
            pa.array([counts.astype("<i8").tobytes()], pa.binary()),
        ],
        names=["kind", "part", "keys", "counts"],
    )


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    columns = (batch.column(c).to_pylist() for c in ("kind", "part", "keys", "counts"))
    for kind, part, keys, counts in zip(*columns, strict=True):
        yield kind, part, np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8")


def merged(blocks: DataFrame) -> DataFrame:
    """One block for each kind and part, of all that tasks have counted; blocks are added as they come in."""

    def add(batches):
        tallies: dict[tuple[int, int], Tally] = {}
        for batch in batches:
            for kind, part, keys, counts in unpacked(batch):
                tallies.setdefault((kind, part), Tally()).add(keys, counts)
        for (kind, part), tally in tallies.items():
            tally.merge()
            yield block(kind, part, tally.keys, tally.counts)

    return blocks.repartition("kind", "part").mapInArrow(add, BLOCK_SCHEMA)
