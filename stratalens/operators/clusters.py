"""Centroids: nearest ones, sums of clusters, nearest neighbours.

Vectors are rows (id, features array<double>). Centroids are few and travel with the function that measures distances
to them, batch by batch in numpy; of clusters only their sums leave the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import sums


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(row, centroid), by differences: equal vectors give equal numbers."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster and distance (squared); the first of equals."""

    def one(column: pa.Array) -> pa.Array:
        x = sums.matrix(column)
        d = squared_distances(x, centroids) if len(x) else np.zeros((0, len(centroids)))
        at = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(x)), at])], names=["cluster", "distance"])

    best = F.arrow_udf(one, "struct<cluster:int,distance:double>")("features")
    return rows.withColumn("_best", best).select("*", F.col("_best.cluster").alias("cluster"), F.col("_best.distance").alias("distance")).drop("_best")


def cluster_sums(rows: DataFrame, centroids: np.ndarray, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each cluster the weighted sum of its rows and their weight; and the weighted sum of squared distances."""
    k, d = centroids.shape

    def part(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        gap = squared_distances(x, centroids)
        at = gap.argmin(axis=1)
        own = np.zeros((len(x), k))
        own[np.arange(len(x)), at] = w
        return np.concatenate([(own.T @ x).ravel(), own.sum(axis=0), [(gap[np.arange(len(x)), at] * w).sum()]])

    got = sums.total(rows, part, k * d + k + 1, (F.lit(1.0) if weight is None else weight).cast("double"))
    return got[: k * d].reshape(k, d), got[k * d : -1], float(got[-1])


def step(assigned: DataFrame, weight: Column | None = None) -> DataFrame:
    """(cluster, pos, v, weight): weighted means of the clusters."""
    w = F.lit(1.0) if weight is None else weight
    long = assigned.select("cluster", w.alias("w"), F.posexplode("features").alias("pos", "x"))
    return long.groupBy("cluster", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("v"), F.sum("w").alias("weight"))


def representatives(assigned: DataFrame, key: str) -> DataFrame:
    """(cluster, key): of each cluster the row nearest to its centroid, the smallest key among equals."""
    return assigned.groupBy("cluster").agg(F.min(F.struct("distance", key)).alias("b")).select("cluster", F.col(f"b.{key}").alias(key))


def k_means(rows: DataFrame, k: int, iterations: int = 20, seed: int = 0, weight: str | None = None, tol: float = 1e-4):
    """Weighted k-means of pyspark.ml over `features`; returns the centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("features").alias("features"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    fitted = KMeans(k=k, maxIter=iterations, seed=seed, tol=tol, weightCol="w").fit(data)
    return np.array(fitted.clusterCenters())


#: Rows of a tile of a reference set or of queries.
TILE = 4096
#: Digits of squared distances that neighbours are ordered by; the smallest id goes first among equals.
DIGITS = 9


def _best(k: int, queries: np.ndarray, known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k nearest known rows of each query."""
    d = (queries * queries).sum(axis=1)[:, None] + (known * known).sum(axis=1) - 2 * queries @ known.T
    d = np.round(np.maximum(d, 0), DIGITS)
    few = min(k, len(known))
    if few < len(known):
        # all that are as near as the k-th, so that ids decide among equals
        bound = np.partition(d, few - 1, axis=1)[:, few - 1]
        width = int((d <= bound[:, None]).sum(axis=1).max(initial=0))
        at = np.argpartition(d, min(width, len(known)) - 1, axis=1)[:, :width]
    else:
        at = np.broadcast_to(np.arange(len(known)), d.shape)
    near = np.take_along_axis(d, at, axis=1)
    order = np.lexsort((ids[at], near), axis=1)[:, :few]
    at = np.take_along_axis(at, order, axis=1)
    return np.take_along_axis(d, at, axis=1), at


def knn(queries: DataFrame, known: DataFrame, value: str, k: int = 4) -> DataFrame:
    """(id, near): of each query its k nearest known rows, as structs (d, id, value) in order. Ids are longs, of either side unique.

    Both sides are packed into tiles of bounded size and written once. A task takes some tiles of queries and reads the known ones past
    them, pair by pair, and keeps only the k nearest so far of its queries; so what is shuffled and written grows with the rows, not
    with the pairs, though every query is compared with every known row."""
    if k < 1:
        raise ValueError("a neighbour is needed")
    left = _tiles(queries.select("id", "features", F.lit(None).cast("double").alias("value")), max(1, TILE // 4)).select("tile", F.col("ids").alias("a"), F.col("x").alias("q"), F.col("d").alias("size"))
    right = _tiles(known.select("id", "features", F.col(value).cast("double").alias("value")), TILE).drop("tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                tile, a, q, size, b, x, d, v = (c[i].as_py() if c.type == pa.int32() else c[i].as_buffer() for c in batch.columns)
                if size != d:
                    raise ValueError("vectors must have one length")
                q, x, known_ids, values = np.frombuffer(q).reshape(-1, size), np.frombuffer(x).reshape(-1, d), np.frombuffer(b, np.int64), np.frombuffer(v)
                parts = [_best(k, q[s : s + 512], x, known_ids) for s in range(0, len(q), 512)]
                dist, at = (np.concatenate(c) for c in zip(*parts))
                near = (dist, known_ids[at], values[at])
                if tile in best:
                    near = tuple(np.concatenate(c, axis=1) for c in zip(best[tile][1:], near))
                    order = np.lexsort((near[1], near[0]), axis=1)[:, :k]
                    near = tuple(np.take_along_axis(c, order, axis=1) for c in near)
                best[tile] = (best[tile][0] if tile in best else np.frombuffer(a, np.int64).copy(), *near)
        for ids, dist, found, values in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, dist.shape[1])), *(pa.array(c.ravel()) for c in (dist, found, values))], names=["id", "d", "known", "value"])

    pairs = left.crossJoin(right.hint("shuffle_replicate_nl")).coalesce(max(1, left.rdd.getNumPartitions()))
    found = pairs.mapInArrow(run, "id long, d double, known long, value double")
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("known").alias("id"), "value"))), 1, k)
    return found.groupBy("id").agg(near.alias("near"))


def _tiles(rows: DataFrame, size: int) -> DataFrame:
    """(tile, ids, x, d, v): about `size` rows in a row, their ids, vectors of d doubles and values as bytes; written."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"), "value", F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(n)).cast("int").alias("tile"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, values = sums.matrix(t["features"].chunk(0)), t["value"].to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.table({"tile": pa.array([t["tile"][0].as_py()], pa.int32()), "ids": [t["id"].to_numpy().tobytes()], "x": [x.tobytes()], "d": pa.array([x.shape[1]], pa.int32()), "v": [values.tobytes()]})

    return written(dealt.repartition(n, "tile").groupBy("tile").applyInArrow(pack, "tile int, ids binary, x binary, d int, v binary"), "tiles")


def knn_mean(queries: DataFrame, known: DataFrame, value: str, k: int = 4) -> DataFrame:
    """(id, value): mean of the value over a query's k nearest rows of a reference set of any size, or all of a smaller one."""
    total = F.aggregate("near", F.lit(0.0), lambda s, t: s + t["value"])
    return knn(queries, known, value, k).select("id", (total / F.size("near")).alias(value))
