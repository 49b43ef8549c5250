"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.llm.common import written


#: Links between the nodes of a step that one task follows at once.
FEW_LINKS = 1_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` of a few links."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            above[top(a)] = top(b)
    yield pa.RecordBatch.from_pydict({"node": pa.array(list(above), pa.int64()), "root": pa.array([top(x) for x in list(above)], pa.int64())})


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` that has another; the root is some node of its component, the same for all.

    Each round sends every node to the first of its neighbours and itself in a drawn order, and from there once more; what is left
    are the links between the nodes so met, a share of those before whatever the ids and shapes are.  The last ``FEW_LINKS`` are
    followed in one task.  Steps live in tables of the shared folder; nothing comes to the driver but a count.
    """
    edges, steps = written(links.select("a", "b").filter("a <> b"), "edges"), []
    while edges.count() > FEW_LINKS:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = {c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("draw"), F.col(c).alias("x")) for c in "ab"}
        # A node's own place in the order is the same in all its rows.
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least(first["a"], first["b"])).alias("first")).select("node", F.col("first.x").alias("root"))
        then = near.select(F.col("node").alias("root"), F.col("root").alias("then"))
        steps.append(written(near.join(then, "root").select("node", F.col("then").alias("root")), "steps"))
        for side in "ab":
            edges = edges.join(steps[-1].select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side)
        left = edges.filter("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        edges = written(left.distinct(), "edges")
    found, *more = [*steps, edges.coalesce(1).mapInArrow(_followed, "node bigint, root bigint")]
    for step in more:
        found = found.join(step.select(F.col("node").alias("root"), F.col("root").alias("then")), "root", "left").select("node", F.coalesce("then", "root").alias("root"))
    return found


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)`` that has another; the component is its smallest node."""
    found = written(roots(links), "roots")
    return found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
