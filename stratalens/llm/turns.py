"""Reassembly of conversation turns that arrive out of order, late and more than once.

A stateful Structured Streaming query. Conversations are dealt by hash into buckets, and a bucket is the group of
applyInPandasWithState. Each batch holds one tick row for every bucket, so that a bucket without arrivals
is called too and can close what has fallen silent; the tick carries the batch's number. A bucket's state is two
columnar tables, compressed by zstd: its open conversations (first and next turn, last batch with an arrival, breaks so far, role of
the last turn released) and the turns that wait, with their texts; and the numbers of closed conversations. A batch is
merged in numpy over all conversations of the bucket: of arrivals of one turn the smallest payload counts, the
earliest stays, and what runs on from the next turn without a gap is released.

The number of buckets follows the number of conversations, so a group stays bounded. The turns of one
conversation that wait lie in one bucket, as their order needs; repeats are met before they are shuffled.

Null turns are dropped; a null role or text is empty; rows whose conv_id is null are one conversation. Repeated rows
are repeats. An empty table gives no events. Very long texts are kept whole. Extra columns are left out, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .store import Store

#: Conversations of a bucket, about, and the least number of buckets.
PER_BUCKET, BUCKETS = 128, 64
NOBODY = -(1 << 63)  # stands for a null conv_id
ROWS = "bucket long, conv_id long, turn long, first long, role string, text string, batch long, tick int"
EVENTS = "event string, conv_id long, turn long, role string, text string, batch long, n_missing long, n_breaks long, pending array<long>"
OPEN = {"conv": np.int64, "first": np.int64, "next": np.int64, "last": np.int64, "breaks": np.int64, "role": object}
WAIT = {"conv": np.int64, "turn": np.int64, "role": object, "text": object}
NO_TICK, TICK, END = 0, 1, 2
Columns = dict[str, np.ndarray]


def _empty(kinds: dict) -> Columns:
    return {k: np.zeros(0, t) for k, t in kinds.items()}


def _packed(columns: Columns) -> bytes:
    arrays = [pa.array(v, pa.large_string() if v.dtype == object else pa.int64()) for v in columns.values()]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(arrays, names=list(columns))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> Columns:
    with pa.ipc.open_stream(data) as source:
        table = source.read_all()
    return {k: table[k].to_numpy(zero_copy_only=False) for k in table.column_names}


def _take(columns: Columns, at: np.ndarray) -> Columns:
    return {k: v[at] for k, v in columns.items()}


def _joined(a: Columns, b: Columns) -> Columns:
    return {k: np.concatenate([a[k], b[k]]) for k in a}


def _found(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and which of them are there."""
    at = np.searchsorted(sorted_keys, keys)
    there = at < len(sorted_keys)
    there[there] = sorted_keys[at[there]] == keys[there]
    return at, there


def _distinct(rows: Columns) -> Columns:
    """Rows in order of conversation and turn; of those of one turn that of the smallest payload."""
    payload = np.zeros(len(rows["conv"]), np.int64)
    order = np.lexsort((rows["turn"], rows["conv"]))
    conv, turn = rows["conv"][order], rows["turn"][order]
    same = (conv[1:] == conv[:-1]) & (turn[1:] == turn[:-1])
    if same.any():
        twin = np.zeros(len(order), dtype=bool)
        twin[1:] |= same
        twin[:-1] |= same
        twin = order[twin]
        keys = np.array([(f"{r}|{t}", r) for r, t in zip(rows["role"][twin], rows["text"][twin])], dtype="object,object")
        ranks = {k: i for i, k in enumerate(sorted(set(keys.tolist())))}
        payload[twin] = [ranks[k] for k in keys.tolist()]
        order = np.lexsort((payload, rows["turn"], rows["conv"]))
        conv, turn = rows["conv"][order], rows["turn"][order]
        same = (conv[1:] == conv[:-1]) & (turn[1:] == turn[:-1])
    return _take(rows, order[np.concatenate([np.ones(min(len(order), 1), bool), ~same])])


def _ranks(conv: np.ndarray) -> np.ndarray:
    """Place of each row among those of its conversation; conv is sorted."""
    new = np.ones(len(conv), dtype=bool)
    new[1:] = conv[1:] != conv[:-1]
    start = np.flatnonzero(new)
    return np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv))))


class Bucket:
    """The conversations of one bucket: open ones and waiting turns in order, closed ones by number."""

    def __init__(self, held: tuple[bytes, bytes, bytes] | None = None):
        self.open, self.wait = (_unpacked(x) for x in held[:2]) if held else (_empty(OPEN), _empty(WAIT))
        self.closed = _unpacked(held[2])["conv"] if held else np.zeros(0, np.int64)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return _packed(self.open), _packed(self.wait), _packed({"conv": self.closed})

    def merge(self, rows: Columns, batch: int, idle: int, end: bool) -> pd.DataFrame:
        """One batch's arrivals (conv, turn, first, role, text); its events."""
        rows = _distinct(rows)
        _, late = _found(rows["conv"], self.closed)
        out = [self._events("reject", _take(rows, late), batch)]
        self._arrive(_take(rows, ~late), batch)
        out += [self._release(batch), self._close(batch, batch - self.open["last"] >= idle if not end else np.ones(len(self.open["conv"]), bool))]
        return pd.concat(out, ignore_index=True)

    @staticmethod
    def _events(event: str, rows: Columns, batch: int, **more: Any) -> pd.DataFrame:
        n = len(rows["conv"])
        blank = pd.Series([pd.NA] * n, dtype="Int64")
        whole = {"event": event, "conv_id": rows["conv"], "turn": rows.get("turn", np.full(n, -1)), "role": rows.get("role"), "text": rows.get("text"), "batch": np.full(n, batch), "n_missing": blank, "n_breaks": blank, "pending": pd.Series([None] * n, dtype=object)} | more
        return pd.DataFrame({k: [v] * n if v is None or isinstance(v, str) else v for k, v in whole.items()})

    def _arrive(self, rows: Columns, batch: int) -> None:
        _, first = np.unique(rows["conv"], return_index=True)
        _, known = _found(rows["conv"][first], self.open["conv"])
        new = _take({"conv": rows["conv"], "first": rows["first"]}, first[~known])
        new |= {"next": new["first"], "last": np.full(len(new["conv"]), batch), "breaks": np.zeros(len(new["conv"]), np.int64), "role": np.full(len(new["conv"]), None, object)}
        every = _joined(self.open, new)
        self.open = _take(every, np.argsort(every["conv"], kind="stable"))
        at, _ = _found(rows["conv"], self.open["conv"])
        self.open["last"] = self.open["last"].copy()  # what Arrow gives is read-only
        self.open["last"][at] = batch
        # turns released before, or waiting already, are repeats
        fresh = _take({k: rows[k] for k in WAIT}, rows["turn"] >= self.open["next"][at])
        every = _joined(self.wait, fresh)
        order = np.lexsort((np.arange(len(every["conv"])), every["turn"], every["conv"]))  # the earliest of a turn comes first
        every = _take(every, order)
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (every["conv"][1:] == every["conv"][:-1]) & (every["turn"][1:] == every["turn"][:-1])
        self.wait = _take(every, ~again)

    def _release(self, batch: int) -> pd.DataFrame:
        wait, held = self.wait, self.open
        at, _ = _found(wait["conv"], held["conv"])
        rank = _ranks(wait["conv"])
        goes = wait["turn"] - rank == held["next"][at]  # turn less rank never falls within a conversation
        before = held["role"][at]
        before[1:][rank[1:] > 0] = wait["role"][:-1][rank[1:] > 0]
        n = len(held["conv"])
        held["breaks"] = held["breaks"] + np.bincount(at[goes], (before == wait["role"])[goes], n).astype(np.int64)
        count = np.bincount(at[goes], minlength=n)
        last = goes & ~np.append((rank[1:] > 0) & goes[1:], np.zeros(min(len(goes), 1), bool))
        held["role"] = held["role"].copy()
        held["role"][at[last]] = wait["role"][last]
        held["next"] = held["next"] + count
        gone, self.wait = _take(wait, goes), _take(wait, ~goes)
        return self._events("release", gone, batch)

    def _close(self, batch: int, silent: np.ndarray) -> pd.DataFrame:
        held, wait = self.open, self.wait
        at, _ = _found(wait["conv"], held["conv"])
        n = len(held["conv"])
        waiting = np.bincount(at, minlength=n)
        bounds = np.concatenate([[0], np.cumsum(waiting)])
        last = held["next"] - 1
        some = waiting > 0
        last[some] = wait["turn"][bounds[1:][some] - 1]
        missing = last - held["next"] + 1 - waiting
        repeats = np.zeros(len(at), dtype=bool)
        repeats[1:] = (at[1:] == at[:-1]) & (wait["turn"][1:] == wait["turn"][:-1] + 1) & (wait["role"][1:] == wait["role"][:-1])
        breaks = held["breaks"] + np.bincount(at, repeats, n).astype(np.int64)
        pending = pd.Series([wait["turn"][bounds[k] : bounds[k + 1]] for k in np.flatnonzero(silent)], dtype=object)
        out = self._events("close", {"conv": held["conv"][silent]}, batch, n_missing=pd.array(missing[silent], "Int64"), n_breaks=pd.array(breaks[silent], "Int64"), pending=pending)
        self.closed = np.sort(np.concatenate([self.closed, held["conv"][silent]]))
        self.open, self.wait = _take(held, ~silent), _take(wait, ~silent[at])
        return out


def _bucket(idle: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        ticks = rows[rows["tick"] != NO_TICK]
        rows = rows[rows["tick"] == NO_TICK]
        bucket = Bucket(state.get if state.exists else None)
        arrived = {"conv": rows["conv_id"].to_numpy(np.int64), "turn": rows["turn"].to_numpy(np.int64), "first": rows["first"].to_numpy(np.int64), "role": rows["role"].to_numpy(object), "text": rows["text"].to_numpy(object)}
        yield bucket.merge(arrived, int(ticks["batch"].max()), idle, bool((ticks["tick"] == END).any()))
        state.update(bucket.packed())

    return run


def events(arriving: DataFrame, idle: int = 2) -> DataFrame:
    """The events of a stream of ROWS, each batch with one tick for every bucket: turns released, arrivals rejected, conversations closed."""
    state = "open binary, wait binary, closed binary"
    return arriving.groupBy("bucket").applyInPandasWithState(_bucket(idle), EVENTS, state, "append", GroupStateTimeout.NoTimeout)


def _move(spark: SparkSession, a: str, b: str) -> bool:
    jvm = spark._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (a, b))
    files = a.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(b.getParent())
    return files.rename(a, b)


def reassemble(arrivals: DataFrame, batches: int, idle: int = 2, name: str = "turns") -> DataFrame:
    """EVENTS of arrivals (conv_id, turn, role, text, batch), a finite number of batches, numbered from 0.

    The batches are written below spark.checkpoint.dir and fed to the query in order, which is started anew for each on one
    checkpoint, and once more for the end; what it appends is read in the end. A conversation starts at its smallest turn of
    all arrivals; `idle` successive batches without its arrivals close it."""
    spark = arrivals.sparkSession
    store = Store(spark, name)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = arrivals.where("turn is not null").select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NOBODY)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("batch").cast("long").alias("batch"), F.struct(F.concat(text("role"), F.lit("|"), text("text")).alias("payload"), text("role").alias("role")).alias("what"))
    # repeats within a batch meet where they are read
    rows = store.save(rows.groupBy("conv_id", "turn", "batch").agg(F.min("what").alias("what")), "arrivals")
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("first"))
    first = store.save(first, "first")
    buckets = max(BUCKETS, -(-first.count() // PER_BUCKET))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).alias("bucket")
    said = rows.join(first, "conv_id").select(bucket("conv_id"), "conv_id", "turn", "first", F.col("what.role").alias("role"), F.substr("what.payload", F.length("what.role") + 2).alias("text"), "batch", F.lit(NO_TICK).alias("tick"))
    every = spark.range(buckets).select(F.col("id").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches).cast("long"))).alias("batch"))
    ticks = every.select("bucket", *(F.lit(0).cast("long").alias(c) for c in ("conv_id", "turn", "first")), F.lit("").alias("role"), F.lit("").alias("text"), "batch", F.when(F.col("batch") == batches, END).otherwise(TICK).alias("tick"))
    # both copies of the batch's number: one names the folder, one stays in the file
    said.union(ticks).withColumn("step", F.col("batch")).write.partitionBy("step").parquet(f"{store.root}/staged")
    store.drop("arrivals")
    store.drop("first")
    for k in range(batches + 1):
        if not _move(spark, f"{store.root}/staged/step={k}", f"{store.root}/fed/{k}"):
            raise OSError(f"batch {k} can't be moved to the stream's folder")
        arriving = spark.readStream.schema(ROWS).parquet(f"{store.root}/fed/*")
        found = events(arriving, idle).writeStream.format("parquet").option("path", f"{store.root}/events").option("checkpointLocation", f"{store.root}/checkpoint")
        found.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(EVENTS).parquet(f"{store.root}/events")
    return out.withColumn("conv_id", F.when(F.col("conv_id") != NOBODY, F.col("conv_id")))
