"""Connected components of an edge table by alternating stars, each round written to the shared folder.

Before and after each round every task ties the nodes that its own edges connect to the smallest of them. That keeps all
components, never makes more edges, and most chains end there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.tables import written

#: Edges that a task looks at together.
BLOCK_EDGES = 1 << 19


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest that the edges reach from it."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (further := new[new]).tobytes() != new.tobytes():
            new = further
        if np.array_equal(new, root):
            return root
        root = new


def _tied(edges: DataFrame) -> DataFrame:
    """Edges from each node to the smallest that it reaches by its block of edges; components stay as they are."""
    def tie(blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(blocks)
        ends = pa.concat_arrays([*table.column("a").chunks, *table.column("b").chunks]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        at = rank[ends.indices.to_numpy()]
        root = least_reached(at[: table.num_rows], at[table.num_rows :], len(rank))
        node = np.flatnonzero(root != np.arange(len(rank)))
        values = ends.dictionary.take(order)
        return pa.RecordBatch.from_arrays([values.take(pa.array(node)), values.take(pa.array(root[node]))], names=["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_EDGES:
                yield tie(held)
                held, n = [], 0
        if n:
            yield tie(held)

    return edges.mapInArrow(scan, edges.schema).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or else the smaller) neighbours of each node to the smallest node around it."""
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = around.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another node."""
    held = edges.groupBy("a").count()
    roots_ = edges.select(F.col("b").alias("a")).distinct()
    return held.where("count > 1").isEmpty() and held.join(roots_, "a", "left_semi").isEmpty()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node that links reach.

    Self-loops and repeated edges are fine; an empty table gives an empty result. Rounds grow with the logarithm of the
    longest chain. Minima are taken before rows meet, so a node with most of the links costs one row per task there;
    its links are narrow rows, which adaptive execution splits in the join.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    # The first distinct also parts the Python work before it from that of _tied, which would double a task's workers.
    now = written(_tied(now.distinct()), "edges")
    while not _stars(now):
        now = written(_tied(_star(_star(now, True), False)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
