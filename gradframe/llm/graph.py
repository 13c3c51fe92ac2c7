"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradframe.plans.lineage import cut, release

EDGES_AT_ONCE = 200_000  # edges that one task joins; tables of more take turns over all tasks


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the least node.

    The edges should have been written before, since they are read twice. Up to ``EDGES_AT_ONCE`` of them are
    joined in one task, as turns over so few edges cost little but tasks. Of more, in turns, every node hangs its larger neighbours, then itself and its smaller
    ones, on the least node it knows. The number of turns grows with the logarithm
    of the longest path. A hub's neighbours are reduced to their minimum inside
    the tasks; its rows in the joins are split by adaptive execution.
    """
    if edges.count() <= EDGES_AT_ONCE:
        return edges.select("a", "b").coalesce(1).mapInArrow(_joined, "node bigint, root bigint")
    edges = cut(_ordered(edges))
    before = None
    while True:
        large = _star(edges.union(edges.select("b", "a")), larger=True)
        edges = cut(_ordered(_star(large, larger=False)))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        del large
        release(edges.sparkSession)
        if state == before:
            break
        before = state
    root = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` of all edges of a task."""
    above: dict[int, int] = {}

    def top(node: int) -> int:
        while (up := above.setdefault(node, node)) != node:
            above[node] = above[up]
            node = up
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a != b and (x := top(a)) != (y := top(b)):
                above[max(x, y)] = min(x, y)
    nodes = list(above)
    columns = [pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["node", "root"])


def _ordered(edges: DataFrame) -> DataFrame:
    """Every edge once, the larger node first; loops are left out."""
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours of ``a`` on the least of its neighbours and itself."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = edges.join(least, "a")
    if larger:
        return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        near.select("a", F.col("m").alias("b"))
    )
