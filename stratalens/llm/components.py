"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .store import Store

#: Edges that a task joins together at most.
EDGES = 1 << 20


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for edges a-b among n nodes held in memory."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), EDGES at a time, as stars: each node with the smallest of those that these edges join it to."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(len(node), at[: len(u)], at[len(u) :])
        far = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= EDGES:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge as u, or none, and no u is a v."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("as_u").alias("a"), F.max("as_v").alias("b")).where("a + b > 1 and a > 0").isEmpty()


def components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """Distributed union-find: alternating large-star and small-star steps over (u, v) long edges, until all are stars.

    Returns (u, v): each node that has an edge, other than the smallest of its component, with
    that smallest node. Each step is written to the store; nothing but whether it was the last
    comes to the driver. Hubs are met by partial minima and by joins that Spark may split. What the edges of a task join is
    joined there before each step, so that fewer steps are left."""
    joined = lambda x: x.distinct().mapInArrow(T.released(_joined), "u long, v long")
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    now, step = store.save(joined(now), f"{name}0"), 0
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store.save(joined(small.union(low.select("u", F.col("m").alias("v")))), f"{name}{step + 1}")
        store.drop(f"{name}{step}")
        now, step = after, step + 1
    return now
