"""Hard negatives by an inverted multi-index with certified windows.

Vectors are cut in two halves, and each half has a codebook of its own; a pair of codewords is a cell.  The score of an anchor with
any member of a codeword's half is at most its score with the codeword plus the anchor's length times the codeword's radius, so the two
halves' bounds add up to a bound for the cell.  Each anchor visits cells in falling order of that bound, by a heap over the two
sorted lists (multi-sequence).  A window, the first rows with a score between two limits, is certified once it is full of scores that
no unvisited cell can reach, or the bound has fallen below its lower limit.

Cells are visited in rounds, each sixteen times as large as the one before: a round joins blocks of anchors with blocks of a cell's
rows and multiplies them as matrices.  What a round finds raises the floor below which the next one need not look.  The codebooks are fitted
on a bounded sample of the vectors; every row is indexed, and bounds hold for any codebook, so results are exact.

Defined results: rows with a null label or id, a null vector, or a null or non-finite component take no part; shorter vectors are filled
up with zeros; equal scores come in the order of their ids; repeated rows are rows of their own, and an anchor is no partner of
itself; components and scores beyond 2 ** 62 are cut to it; no anchors give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramwise.llm.common import table, written

#: Vectors that the codebooks are fitted on, drawn by hash.
SAMPLE = 20_000
#: Rows that a cell should have, and the most codewords of a half: the table of cells has at most the square of that.
CELL_ROWS = 512
MOST_CODES = 64
#: Rows of a block, and anchors that one matrix product takes.
BLOCK_ROWS = 2048
ANCHORS = 256
#: Rows that an anchor visits in the first round, and the growth from round to round.
FIRST_VISIT = 4096
GROWTH = 16
LARGEST = 2**62


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two integer matrices."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as a matrix, filled up with zeros."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    if (sizes == width).all():
        out[:] = values[offsets[0] : offsets[-1]].reshape(-1, width)
    else:
        for i, (low, high) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            out[i, : high - low] = values[low:high]
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def fit_codebook(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Centres of ``codes`` groups of points by Lloyd's method, from well-spread first centres; fewer where points repeat."""
    points = np.unique(points, axis=0).astype(np.float64)
    rng = np.random.default_rng(7)
    if len(points) <= codes:
        return points
    centres = points[rng.choice(len(points), codes, replace=False)]
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=codes)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


@dataclass(frozen=True)
class Codes:
    """The two codebooks, the radius of each codeword and the number of rows of each cell: bounded by ``MOST_CODES``."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    counts: np.ndarray | None = None

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        return x[:, :cut].astype(np.float64), x[:, cut:].astype(np.float64)

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half the most that any member of a codeword can add to the score with each row of ``x``."""
        out = []
        for half, book, radius in zip(self.halves(x), self.books, self.radii, strict=True):
            near, length = half @ book.T, np.linalg.norm(half, axis=1)[:, None]
            bound = near + length * radius
            # Room for rounding.
            out.append(bound + 1e-9 * (np.abs(near) + length * (radius + np.linalg.norm(book, axis=1))) + 1e-6)
        return out

    def visits(self, first: np.ndarray, second: np.ndarray, low: int, high: int, floor: float) -> list[int]:
        """Cells in falling order of ``first[i] + second[j]``, from the one where ``low`` rows have been seen to ``high`` rows, as long as
        the bound is not below ``floor``."""
        a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        u, v = first[a], second[b]
        counts = self.counts[np.ix_(a, b)]
        heap, seen, out = [(-(u[0] + v[0]), 0, 0)], 0, []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < floor or seen >= high:
                break
            if counts[i, j]:
                if seen >= low:
                    out.append(int(a[i]) * len(b) + int(b[j]))
                seen += int(counts[i, j])
            # A cell is reached from the one above it, those of the first row from the left: each once.
            if i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[j]), i + 1, j))
            if i == 0 and j + 1 < len(v):
                heapq.heappush(heap, (-(u[0] + v[j + 1]), 0, j + 1))
        return out


@dataclass(frozen=True)
class Index:
    """All rows in blocks by cell, ``slot, ids, labels, firsts, vectors``, and the codes that lead to them."""

    codes: Codes
    blocks: DataFrame
    rows: int


def build_index(rows: DataFrame, copies: int, codes: int | None = None) -> Index:
    """Index of ``rows(id, label, vector array<bigint>)``; of equal vectors with one label the ``copies`` smallest ids stand for all.

    No window of fewer rows than that can hold another one of them.
    """
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    width = max(2, stats["width"])
    share = min(1.0, SAMPLE / max(stats["n"], 1))
    drawn = rows.select("vector").filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < share * (1 << 30)).distinct().limit(2 * SAMPLE)
    sample = _vectors(drawn.toArrow().column(0).combine_chunks(), width)
    if not len(sample):
        sample = np.zeros((1, width), np.int64)
    k = codes or int(np.clip(round((stats["n"] / CELL_ROWS) ** 0.5), 2, MOST_CODES))
    book = Codes(tuple(fit_codebook(x, k) for x in (sample[:, : width // 2], sample[:, width // 2 :])))
    other = len(book.books[1])

    same = Window.partitionBy("label", "vector").orderBy("id")
    few = rows.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= copies)
    few = few.withColumn("first", F.coalesce(F.lag("id").over(same) != F.col("id"), F.lit(True)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("vector"), width)
            at, away = zip(*((n := _nearest(h, b), np.linalg.norm(h - b[n], axis=1)) for h, b in zip(book.halves(x), book.books, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("first"), _lists(x), pa.array(at[0] * other + at[1]), pa.array(away[0]), pa.array(away[1])],
                names=["id", "label", "first", "vector", "cell", "away_1", "away_2"],
            )

    schema = "id bigint, label bigint, first boolean, vector array<bigint>, cell bigint, away_1 double, away_2 double"
    placed = written(few.select("id", "label", "first", "vector").mapInArrow(place, schema), "placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("away_1").alias("away_1"), F.max("away_2").alias("away_2")).toPandas()
    counts, radii = np.zeros((len(book.books[0]), other), np.int64), (np.zeros(len(book.books[0])), np.zeros(other))
    i, j = cells["cell"].to_numpy(np.int64) // other, cells["cell"].to_numpy(np.int64) % other
    counts[i, j] = cells["rows"]
    np.maximum.at(radii[0], i, cells["away_1"].to_numpy(float))
    np.maximum.at(radii[1], j, cells["away_2"].to_numpy(float))
    codes_ = Codes(book.books, radii, counts)

    # Large cells are cut into blocks; a block is what one task of a join holds at a time.
    parts = np.maximum(1, -(-counts.ravel() // BLOCK_ROWS))
    cuts = F.array(*[F.lit(int(x)) for x in parts])
    # A number from the whole row spreads a cell over its blocks.
    slot = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id", "label", "vector"), F.get(cuts, F.col("cell").cast("int")))
    slotted = placed.select(slot.alias("slot"), "id", "label", "first", "vector").repartition("slot").sortWithinPartitions("slot")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            if not len(slots):
                continue
            x = _vectors(batch.column("vector"), width)
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            first = batch.column("first").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(slots, prepend=slots[0] - 1))
            for low, high in zip(starts, np.append(starts[1:], len(slots)), strict=True):
                yield _block(int(slots[low]), ids[low:high], labels[low:high], first[low:high], x[low:high])

    blocks = written(slotted.mapInArrow(pack, "slot bigint, ids binary, labels binary, firsts binary, vectors binary"), "blocks")
    return Index(codes_, blocks, int(counts.sum()))


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in the least width that holds them, which stands in front."""
    most = int(np.abs(x).max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s - 1))
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, width)


def _block(slot: int, ids: np.ndarray, labels: np.ndarray, first: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    values = [x_.astype("<i8").tobytes() for x_ in (ids, labels)] + [first.astype("?").tobytes(), _narrow(x)]
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], names=["slot", "ids", "labels", "firsts", "vectors"])


def _probes(anchors: DataFrame, codes: Codes, low: int, high: int) -> DataFrame:
    """Blocks of anchors for each block of rows that they visit between ``low`` and ``high`` rows: the columns of ``_block`` and floors."""
    parts = np.maximum(1, -(-codes.counts.ravel() // BLOCK_ROWS))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ANCHORS):
                batch = whole.slice(start, ANCHORS)
                x = _vectors(batch.column("vector"), codes.width)
                floors = batch.column("floor").to_numpy()
                first, second = codes.bounds(x)
                by_cell: dict[int, list[int]] = {}
                for i in range(len(x)):
                    for cell in codes.visits(first[i], second[i], low, high, floors[i]):
                        by_cell.setdefault(cell, []).append(i)
                numbers, ids, labels = (batch.column(c).to_numpy() for c in ("aid", "id", "label"))
                highs = batch.column("highs").to_pylist()
                widest = max(map(len, highs))
                # Shorter lists end with their last limit again.
                highs = np.array([h + h[-1:] * (widest - len(h)) for h in highs])
                for cell, at in by_cell.items():
                    payload = [v[at].astype(t).tobytes() for v, t in ((numbers, "<i8"), (ids, "<i8"), (labels, "<i8"), (floors, "<f8"), (highs, "<f8"))] + [_narrow(x[at])]
                    slots = [(cell << 32) + k for k in range(int(parts[cell]))]
                    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *(pa.array([p] * len(slots), pa.binary()) for p in payload)], names=_PROBE)

    return anchors.mapInArrow(plan, "slot bigint, " + ", ".join(f"{c} binary" for c in _PROBE[1:]))


_PROBE = ["slot", "aids", "anchor_ids", "anchor_labels", "floors", "highs", "anchor_vectors"]


def _found(probes: DataFrame, index: Index, same_label: bool, wanted: int) -> DataFrame:
    """``aid, id, score``: rows of the visited blocks that may be among the first ``wanted`` of a window of their anchor.

    Of each block only the first ``wanted`` rows below each upper limit come out, so their number is bounded.
    """
    width = index.codes.width

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "slot"}
            for k in range(batch.num_rows):
                row = {n: v[k] for n, v in columns.items()}
                ids, labels = (np.frombuffer(row[n], "<i8") for n in ("ids", "labels"))
                first, x = np.frombuffer(row["firsts"], "?"), _wide(row["vectors"], width)
                aids, own, mine = (np.frombuffer(row[n], "<i8") for n in ("aids", "anchor_ids", "anchor_labels"))
                floors = np.frombuffer(row["floors"], "<f8")[:, None]
                highs = np.frombuffer(row["highs"], "<f8").reshape(len(aids), -1)
                a = _wide(row["anchor_vectors"], width)
                scores = product(a, x)
                fits = (mine[:, None] == labels) == same_label
                fits &= (scores >= floors) & (scores <= highs.max(1, initial=-np.inf)[:, None])
                if same_label:
                    for i, j in zip(*np.nonzero((own[:, None] == ids) & fits & first), strict=True):
                        if (a[i] == x[j]).all():
                            fits[i, j] = False
                out = []
                for i in np.flatnonzero(fits.any(1)):
                    at = np.flatnonzero(fits[i])
                    at = at[np.lexsort((ids[at], -scores[i, at]))]
                    # Of each window the first ones below its upper limit.
                    starts = np.searchsorted(-scores[i, at], -highs[i])
                    chosen = np.unique(starts[:, None] + np.arange(wanted))
                    at = at[chosen[chosen < len(at)]]
                    out.append((np.full(len(at), aids[i]), ids[at], scores[i, at]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["aid", "id", "score"])

    joined = probes.join(index.blocks, "slot").select(*_PROBE[1:], "ids", "labels", "firsts", "vectors")
    return joined.mapInArrow(score, "aid bigint, id bigint, score bigint")


def first_in_windows(anchors: DataFrame, windows: DataFrame, index: Index, same_label: bool, wanted: int) -> DataFrame:
    """``aid, window, rank, id, score``: the first ``wanted`` rows, by falling score and then id, of each window of each anchor.

    ``anchors(aid, id, label, vector)``; ``windows(aid, window, low, high)``, null being no limit; rows have the anchor's label or another one.
    """
    anchors, windows = written(anchors, "anchors"), written(windows, "windows")
    hits, seen, budget = None, 0, FIRST_VISIT
    infinite = float("inf")
    by = Window.partitionBy("aid", "window").orderBy(F.desc("score"), "id", "copy")
    while True:
        limits = windows
        if hits is not None:
            full = hits.filter(F.col("rank") == wanted).select("aid", "window", F.col("score").alias("reached"))
            limits = windows.join(full, ["aid", "window"], "left").withColumn("low", F.coalesce("reached", "low"))
        limits = limits.groupBy("aid").agg(
            F.min(F.coalesce(F.col("low").cast("double"), F.lit(-infinite))).alias("floor"), F.sort_array(F.collect_set(F.coalesce(F.col("high").cast("double"), F.lit(infinite)))).alias("highs")
        )
        probes = _probes(anchors.join(limits, "aid"), index.codes, seen, budget)
        if hits is not None:
            probes = written(probes, "probes")
            if probes.isEmpty():
                return hits
        found = _found(probes, index, same_label, wanted)
        inside = F.coalesce(F.col("score") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("score") <= F.col("high"), F.lit(True))
        new = found.join(windows, "aid").filter(inside).select("aid", "window", "id", "score", F.lit(budget).alias("copy"))
        if hits is not None:
            new = new.unionByName(hits.select("aid", "window", "id", "score", "copy"))
        hits = written(new.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= wanted), "hits")
        if budget >= index.rows:
            return hits
        seen, budget = budget, budget * GROWTH


def prepared(df: DataFrame, id_: Column, label: Column, vector: Column, scale: int = 256) -> DataFrame:
    """``id, label, vector`` of the rows that take part, components as integers."""
    number = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf")))
    most = F.lit(float(LARGEST))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(-most, F.least(most, number(x) * scale))).cast("bigint"))
    usable = label.isNotNull() & id_.isNotNull() & vector.isNotNull() & ~bad
    return df.filter(F.coalesce(usable, F.lit(False))).select(id_.cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole.alias("vector"))


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), codes: int | None = None
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows and anchors as ``prepared`` makes them.

    A negative's score is at most the positive's and at least ``least`` of it.
    """
    rows = written(rows, "vectors")
    index = build_index(rows, max(positives, negatives) + 1, codes)
    anchors = written(anchors.withColumn("aid", F.monotonically_increasing_id()), "anchors")
    nothing = F.lit(None).cast("bigint")
    found = first_in_windows(anchors, anchors.select("aid", F.lit(0).alias("window"), nothing.alias("low"), nothing.alias("high")), index, True, positives)
    found = written(found.select("aid", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    num, den = least
    low = F.ceil(F.col("positive_score").cast("decimal(20,0)") * num / den).cast("bigint")
    windows = found.select("aid", "window", low.alias("low"), F.col("positive_score").alias("high")).filter("low <= high")
    wrong = first_in_windows(anchors.join(windows.select("aid").distinct(), "aid", "left_semi"), windows, index, False, negatives)
    out = wrong.join(found, ["aid", "window"]).join(anchors.select("aid", F.col("id").alias("anchor_id")), "aid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all of them."""
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = prepared(table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"))
    return hard_negatives(rows, rows.filter("id % 100 = 0"))


ORACLE = """
with r as (
  select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.k, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from r a join r b on a.k <> b.k where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by k order by score desc, vec_id) <= 5),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    (row_number() over (partition by p.k, p.vec_id order by s.score desc, s.vec_id))::int as rank
  from p join s on s.k = p.k and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
