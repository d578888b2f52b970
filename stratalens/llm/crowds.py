"""Links among the rows of a bucket, whatever its size.

A bucket's rows are near or not by a test of two rows. Small buckets are compared where they lie; the rows of a
crowded one are dealt into tiles, and each pair of tiles is a group of work of its own, so that every two
rows of the bucket meet and no task holds more than two tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .components import roots
from .groups import grouped
from .store import tasks

#: Rows of a bucket that one task compares; a larger bucket is dealt into tiles of so many rows.
LIMIT = 4096
BLOCK = 64


def links_within(rows: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join every two rows which are near, directly or through others; near gives a matrix.

    A row takes those near it into its cluster; what is left is compared with every member of that
    cluster, so only pairs within a cluster, which are joined already, are spared."""
    a, b, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(rows))
    while len(rest) > 1:
        hit = near(rows[rest[:1]], rows[rest])[0]
        hit[0] = True
        mine, rest = rest[hit], rest[~hit]
        found = [mine[1:]]
        for k in range(1, len(mine), BLOCK):
            if len(rest):
                found.append(rest[near(rows[mine[k : k + BLOCK]], rows[rest]).any(axis=0)])
        found = np.concatenate(found)
        a.append(found)
        b.append(np.full(len(found), mine[0]))
    return np.concatenate(a), np.concatenate(b)


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (u, v) of ids, of edges between positions; equal ids are one node."""
    node, back = np.unique(ids[np.concatenate([a, b])], return_inverse=True)
    root = roots(len(node), back[: len(a)], back[len(a) :])
    far = np.flatnonzero(root != np.arange(len(node)))
    return node[far], node[root[far]]


def dealt(crowd: DataFrame, rows_of: Callable[[pa.Table], np.ndarray], near: Callable) -> DataFrame:
    """(u, v) over the rows (bucket, id, row) of crowded buckets; rows_of reads the column row."""
    many = tasks(crowd.sparkSession)
    blocks = crowd.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / LIMIT).cast("int").alias("blocks"))
    tiled = crowd.join(blocks, "bucket").withColumn("tile", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("bucket", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["bucket", "a", "b"]):
            u, v = forest(g["id"].to_numpy(), *links_within(rows_of(g), near))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return tiled.repartition(many, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "id").mapInArrow(T.released(run), "u long, v long")
