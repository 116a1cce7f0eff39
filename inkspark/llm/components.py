"""Connected components of an edge table, by alternating large-star and small-star rounds; few links end in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stash import drop, stash

#: Links (16 bytes each) that one task of an executor joins up by itself; more go through rounds.
TASK_LINKS = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the links, and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _in_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]
    if parts:
        nodes, roots = joined_up(*np.concatenate(parts, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links of longs to ``(node, root)``: root is the smallest node of the component, itself included.

    Nodes without a link (and null ends) do not occur in the result; self-links and repeated links change nothing. Every
    round is a few shuffles of the links that are left (a hub's links are split by the adaptive skew join), written to
    the shared folder; the number of rounds grows with the logarithm of a component's diameter. Up to TASK_LINKS links
    are joined up in one task instead. Nothing but a count and a checksum per round reaches the driver, which would hold
    what is broadcast: the joins are never broadcast.
    """
    now, seen = stash(edges.select("a", "b").where("a <> b").distinct(), "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        if seen is None and mark[0] <= TASK_LINKS:
            return now.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_in_a_task, "node long, root long")
        after = stash(_small_star(_large_star(now).where("a <> b").distinct()).distinct(), "links")
        drop(now)
        now, seen = after, mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
