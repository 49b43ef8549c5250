"""Keeping a table that several jobs read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Cache ``df`` for the block.  What an executor loses with its part of the cache is computed again.

    No session setting is touched.  A session with ``spark.sql.optimizer.canChangeCachedPlanOutputPartitioning`` lets
    adaptive execution merge small partitions of the cached table, which is worth setting with many shuffle partitions.
    """
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
