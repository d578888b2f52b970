"""Sums of arrays over a table of vectors, and matrices applied to one.

Vectors are rows (id, features array<double>), read batch by batch as numpy matrices. A sum is taken within each task, then
over groups of tasks, then on the driver, which gets as many arrays as the square root of the shuffle partitions; an array
has the size of a model, never of the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 2048
#: Bytes of vectors in a task of a table that is held.
HELD = 16 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, which must be equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and (column.null_count or len(flat) % len(column) or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1):
        raise ValueError("vectors must have one length")
    return flat.reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (x.shape[1] if x.ndim > 1 else 0), pa.int32()), pa.array(x.ravel(), pa.float64()))


def total(rows: DataFrame, part: Callable[..., np.ndarray], size: int, *more: Column, tasks: int | None = None) -> np.ndarray:
    """The sum over all rows of part(x, *columns), an array of `size` numbers for a matrix of some rows' features and further columns.
    Of tables known to have few tasks the driver gets a sum of each at once."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                out += part(matrix(some.column(0)), *(some.column(j).to_numpy(zero_copy_only=False) for j in range(1, some.num_columns)))
        yield pa.RecordBatch.from_arrays([lists(out[None])], names=["sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            out += matrix(batch.column(0)).sum(axis=0) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([lists(out[None])], names=["sums"])

    narrow = rows.select("features", *(c.alias(f"c{k}") for k, c in enumerate(more)))
    parts = narrow.mapInArrow(partial, "sums array<double>")
    groups = max(1, int(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    parts = parts if tasks is not None and tasks <= groups else parts.repartition(groups).mapInArrow(merged, "sums array<double>")
    found = parts.collect()  # the square root of the shuffle partitions
    return np.sum([r["sums"] for r in found], axis=0) if found else np.zeros(size)


def dimension(rows: DataFrame) -> int:
    """The length of the vectors; an empty table is an error."""
    row = rows.select(F.size("features")).first()
    if row is None:
        raise ValueError("no samples")
    return row[0]


def tasks(n: int, d: int) -> int:
    """The tasks, at most, of a table of n vectors that is held."""
    return max(1, -(-n * d * 8 // HELD))


@contextmanager
def held(rows: DataFrame) -> Iterator[DataFrame]:
    """The rows, made once for several passes, in no more tasks than their size asks for."""
    n = rows.count()
    kept = rows.coalesce(tasks(n, dimension(rows)) if n else 1).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def gram(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of rows, their sum and the sum of their outer products."""
    d = dimension(rows)
    sums = total(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]), 1 + d + d * d)
    return int(sums[0]), sums[1 : d + 1], sums[d + 1 :].reshape(d, d)


def covariance(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and the population covariance. Rows are taken less one of them first, so that large means cost no digits."""
    d, one = dimension(rows), np.array(rows.select("features").first()[0], float)
    sums = total(rows, lambda x: np.concatenate([[len(x)], (x - one).sum(axis=0), ((x - one).T @ (x - one)).ravel()]), 1 + d + d * d)
    n, mean = sums[0], sums[1 : d + 1] / sums[0]
    return mean + one, sums[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)


def applied(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows with features f(features), batch by batch; f gives a row for each row."""

    def one(column: pa.Array) -> pa.Array:
        x = matrix(column)
        return lists(f(x)) if len(x) else pa.array([], pa.list_(pa.float64()))

    return rows.withColumn("features", F.arrow_udf(one, "array<double>")("features"))
