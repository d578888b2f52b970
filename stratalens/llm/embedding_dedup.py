"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class. Every class's unit vector u is quantised once to int8 values q with
scale s, and the norm of its own error e = u - s q is kept. The classes of a label are dealt into tiles of
about TILE rows, and each pair of tiles is one group of work, to which only the int8 rows are sent.
|u.v - s s' q.q'| <= (1 + |e|) |e'| + |e|, so pairs whose product less that bound reaches the threshold are linked, those
whose product plus the bound doesn't are not, and only the rows of pairs between are sent to their tile pair again,
whole, where those pairs are decided in double precision. A tile pair sends on link counts and the spanning
forest of its links, never the pairs. int8 products are exact in float32 matrix products of at most 1,024
columns, which are added up in float64.

All pairs within a label are compared, as the contract asks; work is even over tile pairs.

Null or zero vectors, and vectors with null or non-finite components, or whose label is
null, link with nothing. Vectors are scaled by a power of two first, so that no norm overflows or underflows.
Vectors of different lengths are never linked. Rows that repeat
an id are vectors of their own; a null id gets a null component and is kept unless linked
to an id. Extra columns are left out, whatever their names. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .components import components, roots
from .groups import grouped
from .store import Store, tasks

TILE, COLUMNS, ROWS = 1024, 1024, 1 << 16


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two to a largest component near 1, and their norms."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, and bounds on the norms of their errors; x has unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - scale[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, error


def products(q: np.ndarray, scale: np.ndarray, error: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a row of a and one of b surely reach the threshold, and which may, the sure ones left out."""
    q = q.astype(np.float32)
    product = np.zeros((len(a), len(b)))
    for c in range(0, q.shape[1], COLUMNS):
        product += q[a, c : c + COLUMNS] @ q[b, c : c + COLUMNS].T
    product *= scale[a][:, None]
    product *= scale[b][None, :]
    # (1 + e) e' + e = (1 + e)(1 + e') - 1
    bound = (1 + error[a])[:, None] * (1 + error[b])[None, :] - 1 + 1e-9
    apart = a[:, None] != b[None, :]
    sure = (product - bound >= threshold) & apart
    return sure, (product + bound >= threshold) & apart & ~sure


def _links(sure: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(sure)
    return a[i], b[j]


def _counted(ids: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each linked row its id, that of its root, and how many vectors it is linked with; two: the tiles differ."""
    n = np.bincount(i, copies[j], minlength=len(ids)).astype(np.int64)
    if two:
        n += np.bincount(j, copies[i], minlength=len(ids)).astype(np.int64)
    root, hit = roots(len(ids), i, j), np.flatnonzero(n > 0)
    return ids[hit], ids[root[hit]], n[hit]


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.diff(batch.column("embedding").offsets.to_numpy())
        for d in np.unique(size):
            rows = batch.filter(pa.array(size == d))
            x, norm = units(rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            q, scale, error = quantise(x / norm[:, None])
            yield pa.RecordBatch.from_arrays([rows.column("team"), rows.column("id"), rows.column("copies"), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(error)], names=["team", "id", "copies", "q", "scale", "error"])


def _out(u, v, n, team=None, a=None, b=None, tile=None) -> pa.RecordBatch:
    blank = lambda x, t: pa.nulls(len(u), t) if x is None else pa.array(np.broadcast_to(x, len(u)), t)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), blank(v, pa.int64()), blank(n, pa.int64()), blank(team, pa.int64()), blank(a, pa.int32()), blank(b, pa.int32()), blank(tile, pa.int32())], names=["u", "v", "n", "team", "a", "b", "tile"])


def _compare(threshold: float):
    """Sure links of a tile pair, and, without v and n, the rows of its pairs that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["team", "a", "b"]):
            ids, tile, copies, scale, error = (g[k].to_numpy() for k in ("id", "tile", "copies", "scale", "error"))
            q = np.frombuffer(b"".join(g["q"].to_pylist()), np.int8).reshape(len(ids), -1)
            first, second = g["a"][0].as_py(), g["b"][0].as_py()
            a, b = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
            sure, maybe = products(q, scale, error, a, b, threshold)
            yield _out(*_counted(ids, copies, *_links(sure, a, b), first != second))
            ask = np.union1d(a[maybe.any(axis=1)], b[maybe.any(axis=0)])
            yield _out(ids[ask], None, None, g["team"][0].as_py(), first, second, tile[ask])

    return run


def links(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in a, j in b, i != j) that the bounds leave open and whose cosine in double precision is >= threshold."""
    x, norm = units(x)
    _, maybe = products(*quantise(x / norm[:, None]), a, b, threshold)
    i, j = _links(maybe, a, b)
    sure = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), ROWS):
        p, r = i[k : k + ROWS], j[k : k + ROWS]
        sure[k : k + ROWS] = np.einsum("ij,ij->i", x[p], x[r]) / (norm[p] * norm[r]) >= threshold
    return i[sure], j[sure]


def _decide(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["team", "a", "b"]):
            ids, tile, copies = (g[k].to_numpy() for k in ("id", "tile", "copies"))
            x = g["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            first, second = g["a"][0].as_py(), g["b"][0].as_py()
            yield _out(*_counted(ids, copies, *links(x, np.flatnonzero(tile == first), np.flatnonzero(tile == second), threshold), first != second))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; threshold is above 0 and below 1."""
    spark = vectors.sparkSession
    store, many = Store(spark, "embedding"), tasks(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"), F.col(label).alias("label"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("digest", F.when(usable, F.sha2(F.to_json(F.struct("label", F.transform("x", lambda v: v + 0.0).alias("x"))), 256)))
    rows = store.save(rows, "rows")
    # a class is worked on under a number of its own, as ids may be null
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("x").alias("embedding"), F.first("label").alias("label"))
    classes = classes.withColumn("id", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")).withColumn("team", F.xxhash64("label", F.size("embedding")))
    classes = store.save(classes, "classes")
    small = store.save(classes.select("team", "id", "copies", "embedding").mapInArrow(T.released(_quantised), "team long, id long, copies long, q binary, scale double, error double"), "small")
    blocks = small.groupBy("team").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    dealt = small.join(blocks, "team").withColumn("tile", F.pmod("id", "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("team", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id", "copies", "q", "scale", "error")
    kind = "u long, v long, n long, team long, a int, b int, tile int"
    keys = ("team", "a", "b")
    first = store.save(dealt.repartition(many, *keys).sortWithinPartitions(*keys, "id").mapInArrow(T.released(_compare(threshold)), kind), "first")
    asked = first.where("v is null").select("team", "a", "b", "tile", F.col("u").alias("id")).join(classes.select("id", "copies", "embedding"), "id")
    second = asked.select(*keys, "tile", "id", "copies", "embedding").repartition(many, *keys).sortWithinPartitions(*keys, "id").mapInArrow(T.released(_decide(threshold)), kind)
    found = store.save(first.where("v is not null").select("u", "v", "n").union(second.select("u", "v", "n")), "found")
    counts = found.groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "id")
    joined = components(found.select("u", "v"), store, "links").withColumnRenamed("u", "id").withColumnRenamed("v", "root")
    classes = classes.select("digest", "id", "first", "copies").join(joined, "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = classes.groupBy("root").agg(F.min("first").alias("component"))
    classes = store.save(classes.join(named, "root").select("digest", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "named")
    out = rows.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
