"""The groups of a partition that is sorted by its keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by keys, each whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if last is not None and tuple(c[0] for c in columns) != last:
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(s, e - s))
            if e < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def grouped_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """As grouped(), but all groups that a batch completes in one table, with the bounds of each."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        columns = [table[k].to_numpy() for k in keys]
        change = np.zeros(table.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        cuts = bounds(table)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]), cuts[:-1]
            held = table.slice(cuts[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, bounds(table)
