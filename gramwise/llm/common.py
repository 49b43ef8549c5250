"""Helpers shared by the text operators: tables, shared storage, words and shingles in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Bytes of text that numpy works on at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20260101))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_FACTOR = _RNG.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; on local masters without that setting, a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and any executor may read it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offsets of its values; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values with at most ``limit`` bytes each, or one value."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2**64; kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        have = np.full(size, base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads differences over all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any run of bytes: see ``run_hashes``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(_BASE_INVERSE, len(sums))[start])


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between separators (ASCII white space), and for each document the number of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside
    end[:-1] = inside[:-1] & (~inside[1:] | cut[1:-1])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each document the hashes of its runs of ``words`` words, ASCII letters in lower case, in text order.

    A document with fewer words has one shingle, its whole sequence; one without words has none.
    """
    low = _LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    word = run_hashes(prefix_hashes(low), starts, ends)
    n = len(word)
    runs = np.zeros(0, np.uint64)
    factor = _WORD_FACTOR if words == SHINGLE_WORDS else powers(int(_WORD_FACTOR[0]), words + 1)[1:]
    if n >= words:
        runs = word[: n - words + 1] * factor[0]
        for k in range(1, words):
            runs += word[k : n - words + 1 + k] * factor[k]
        runs = mix(runs)
    out = []
    for low_word, high_word in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        count = high_word - low_word
        if count >= words:
            out.append(runs[low_word : high_word - words + 1])
        elif count:
            out.append(mix((word[low_word:high_word] * factor[:count]).sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(runs[:0])
    return out


def is_held_out(id_column: str, modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text has the given remainder; a null id never has."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Bits of a key filter: its size does not depend on the keys.
FILTER_BITS = 1 << 24


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit set of fixed size with all values of a bigint column, which must be hashes; other values may pass too."""
    slot = F.shiftright(F.pmod(column, F.lit(FILTER_BITS)), 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")
    rows = keys.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["slot"].to_numpy(int)] = rows["bits"].to_numpy(np.int64)
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % FILTER_BITS
    return (bits[at >> 6] >> (at & 63) & 1).astype(bool)
