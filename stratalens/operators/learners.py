"""Prototype learners over whole tables of vectors.

Vectors are rows (id, features array<double>). Draws go by md5 digests of keys, so they are the same on any
partitioning. What a learner needs of the table is aggregated by Spark (a few rows, moments, a histogram, means
of clusters); only numbers of the prototypes' size come to the driver."""

from __future__ import annotations

import uuid
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder
from . import clusters, sums
from .draws import draw, drawn

#: Digits of costs that medoids are compared by.
DIGITS = 6


def digest_order(rows: DataFrame, key: str) -> DataFrame:
    return rows.orderBy(F.md5(F.col(key).cast("string")), key)


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of the smallest digests of their ids, in order."""
    return digest_order(rows, "id").limit(n)


def _bank(rows: DataFrame, n: int) -> np.ndarray:
    found = [r["features"] for r in rows.select("features").collect()]  # n rows at most
    if len(found) < n:
        raise ValueError("fewer samples than prototypes")
    return np.array(found, float)


def imprint(rows: DataFrame, n: int) -> np.ndarray:
    """Drawn vectors themselves."""
    return _bank(_first(rows, n), n)


def shuffle(rows: DataFrame, n: int) -> np.ndarray:
    """Drawn vectors, the elements of each in the order of their places' digests."""
    placed = F.transform("features", lambda v, i: F.struct(F.md5(F.concat_ws(":", F.col("id").cast("string"), i.cast("string"))).alias("d"), i.alias("i"), v.alias("v")))
    return _bank(_first(rows, n).withColumn("features", F.transform(F.array_sort(placed), lambda s: s["v"])), n)


def uniform(n: int, size: int, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    return np.array([[low + (high - low) * draw("uniform", k, i) for i in range(size)] for k in range(n)])


def moments(rows: DataFrame) -> tuple[int, float, float]:
    """Number, mean and population deviation of all elements."""
    total = lambda f: F.sum(F.aggregate("features", F.lit(0.0), lambda s, v: s + f(v)))
    n, s = rows.agg(F.sum(F.size("features")), total(lambda v: v)).first()
    if not n:
        raise ValueError("no samples")
    mean = s / n
    return n, mean, (rows.agg(total(lambda v: (v - mean) * (v - mean))).first()[0] / n) ** 0.5


def normal(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """Draws with the mean and deviation of all elements."""
    _, mean, std = moments(rows)
    one = lambda k, i: np.sqrt(-2 * np.log(draw("normal", k, i, 1))) * np.cos(2 * np.pi * draw("normal", k, i, 2))
    return np.array([[mean + std * one(k, i) for i in range(size)] for k in range(n)])


def histogram(rows: DataFrame, n: int, size: int, bins: int = 100, resolution: float = 0.0025) -> np.ndarray:
    """Draws from the elements' histogram, even within a bin; a bin has its share over the resolution in whole
    tickets, so bins of a smaller share than the resolution are left out."""
    cells = rows.select(F.explode("features").alias("v"))
    low, high, total = cells.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not total:
        raise ValueError("no samples")
    width = (high - low) / bins or 1.0
    counted = cells.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).count().collect()  # at most `bins` rows
    tickets = [b for b, c in sorted(map(tuple, counted)) for _ in range(int(c / (total * resolution)))]
    if not tickets:
        raise ValueError("the resolution is too coarse for the histogram")
    one = lambda k, i: low + (tickets[int(draw("bin", k, i) * len(tickets))] + draw("within", k, i)) * width
    return np.array([[one(k, i) for i in range(size)] for k in range(n)])


def steps(rows: DataFrame, centres: np.ndarray, rounds: int | None, weight: Column | None = None, tol: float = 0.0) -> np.ndarray:
    """Weighted Lloyd steps; a cluster without rows, or without weight, keeps its centroid. It ends when the centroids move by
    no more than tol, squared and summed; tol is a share of the elements' mean variance in scale_free(). Without rounds it goes on
    until then: a step that moves further makes the clusters' squares less by as much, times the rows of a cluster."""
    for _ in count() if rounds is None else range(rounds):
        total, mass, _ = clusters.cluster_sums(rows, centres, weight)
        moved = np.where(mass[:, None] > 0, total / np.where(mass > 0, mass, 1)[:, None], centres)
        gap = float(((moved - centres) ** 2).sum())
        centres = moved
        if not gap > tol:  # also where vectors aren't numbers
            break
    return centres


def scale_free(rows: DataFrame, tol: float) -> float:
    """A tolerance as a share of the elements' mean variance."""
    _, c = sums.covariance(rows)
    return tol * float(np.diag(c).mean())


def k_means(rows: DataFrame, n: int, rounds: int | None = 10, weight: Column | None = None, tol: float = 0.0, start: str = "imprint") -> np.ndarray:
    """Weighted k-means from drawn vectors ("imprint") or from spread ones ("spread")."""
    centres = spread(rows, n, weight=weight) if start == "spread" else imprint(rows, n)
    return steps(rows, centres, rounds, weight, tol)


def spread(rows: DataFrame, n: int, rounds: int = 4, factor: int = 2, weight: Column | None = None) -> np.ndarray:
    """Starts that lie apart. In each round every row is drawn with odds of factor * n times its share of the weighted squared
    distance to those drawn before (so about factor * n a round); candidates weigh what is nearest to them, and n of them stay:
    the heaviest, then again and again the one with the largest weight times squared distance to those that stay."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    found = imprint(rows, 1)
    for r in range(rounds):
        _, _, cost = clusters.cluster_sums(rows, found, w)
        if cost <= 0:
            break
        odds = F.col("distance") * w * (factor * n / cost)
        picked = clusters.nearest(rows, found).where(odds > drawn("spread", r, F.col("id"))).orderBy("id").select("features").collect()  # factor * n rows, about
        found = np.unique(np.concatenate([found, *(np.array([p["features"]], float) for p in picked)]), axis=0)
    if len(found) < n:
        more = imprint(rows, n)
        found = np.concatenate([found, more[~(more[:, None] == found[None]).all(axis=2).any(axis=1)]])
    if len(found) < n:  # vectors repeat
        return np.concatenate([found, imprint(rows, n)])[:n]
    _, mass, _ = clusters.cluster_sums(rows, found, w)
    chosen = [int(mass.argmax())]
    gap = ((found - found[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n:
        score = np.where(np.isin(np.arange(len(found)), chosen), -1.0, gap * mass)
        chosen.append(int(score.argmax()))
        gap = np.minimum(gap, ((found - found[chosen[-1]]) ** 2).sum(axis=1))
    return found[chosen]


class MiniBatch:
    """Centroids with counts, moved by one batch after another: each is the weighted mean of what it has met."""

    def __init__(self, centres: np.ndarray, counts: np.ndarray | None = None, sphered: bool = False):
        self.centres, self.sphered = np.array(centres, float), sphered
        self.counts = np.zeros(len(centres)) if counts is None else np.array(counts, float)

    def update(self, batch: DataFrame, weight: Column | None = None) -> float:
        """Takes a batch in; the weighted sum of squared distances to the centroids before."""
        total, mass, inertia = clusters.cluster_sums(batch, self.centres, weight)
        some = mass > 0
        self.centres[some] = (self.centres[some] * self.counts[some, None] + total[some]) / (self.counts[some] + mass[some])[:, None]
        self.counts = self.counts + mass
        if self.sphered:
            self.centres[some] /= np.maximum(np.linalg.norm(self.centres[some], axis=1, keepdims=True), 1e-12)
        return inertia

    def deal_anew(self, batch: DataFrame, turn: int, ratio: float = 0.01, weight: Column | None = None) -> int:
        """Centroids of few counts (1, or ratio of the largest) become rows of the batch, drawn by cumulative weight: a row's
        odds are its weight times how much nearer than the farthest row it lies to its centroid. How many did."""
        low = np.flatnonzero((self.counts <= 1) | (self.counts <= ratio * self.counts.max()))
        if not len(low):
            return 0
        near = clusters.nearest(batch, self.centres)
        far = near.agg(F.max("distance")).first()[0]
        if far is None:
            return 0
        w = F.lit(1.0) if weight is None else weight.cast("double")
        odds = w * (F.lit(float(far)) - F.col("distance"))
        # the first of exponential clocks of these rates: a draw without repeats by cumulative weight, spread over tasks
        clock = -F.log(drawn("anew", turn, F.col("id"))) / odds
        for k, r in zip(low, near.where(odds > 0).orderBy(clock, "id").limit(len(low)).collect()):
            self.centres[k], self.counts[k] = r["features"], 0.0
        return len(low)


def dealt_batches(rows: DataFrame, batches: int, weight: Column | None = None) -> DataFrame:
    """(id, features, w, batch) of all rows, dealt by digests of ids and written by batch, so that a step reads its batch alone."""
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    folder = f"{shared_folder(rows.sparkSession)}/batches-{uuid.uuid4().hex}"
    dealt = rows.select("id", "features", w.alias("w"), F.floor(drawn("batch", F.col("id")) * batches).cast("int").alias("batch"))
    dealt.write.partitionBy("batch").parquet(folder)
    return rows.sparkSession.read.schema("id long, features array<double>, w double, batch int").parquet(folder)


def mini_batch_steps(rows: DataFrame, centres: np.ndarray, batches: int, count: int, weight: Column | None = None, sphered: bool = False) -> MiniBatch:
    """A number of mini-batch steps and nothing else."""
    dealt, model = dealt_batches(rows, batches, weight), MiniBatch(centres, sphered=sphered)
    for s in range(count):
        model.update(dealt.where(F.col("batch") == s % batches), F.col("w"))
    return model


def mini_batch(rows: DataFrame, n: int, batches: int = 10, rounds: int = 20, weight: Column | None = None, start: str | np.ndarray = "spread", patience: int = 10, ratio: float = 0.01, tol: float = 0.0, sphered: bool = False) -> tuple[np.ndarray, list[float]]:
    """Weighted mini-batch k-means over all rows, dealt once into batches by digests of ids; the smoothed inertia of each step.

    It ends after `rounds` passes, when the smoothed inertia hasn't fallen for `patience` steps, or when centroids move by no
    more than tol. Centroids of few counts are dealt anew every 10 steps, and later the more the fewest counts are."""
    dealt = dealt_batches(rows, batches, weight)
    mass = float(dealt.agg(F.sum("w")).first()[0] or 0)
    if not mass:
        raise ValueError("no samples")
    centres = start if isinstance(start, np.ndarray) else spread(rows, n, weight=weight) if start == "spread" else imprint(rows, n)
    model, alpha, smooth, best, waited = MiniBatch(centres, sphered=sphered), min(1.0, 2 / batches), [], np.inf, 0
    for s in range(rounds * batches):
        batch = dealt.where(F.col("batch") == s % batches)
        if (s + 1) % (10 + int(model.counts.min())) == 0:
            model.deal_anew(batch, s, ratio, F.col("w"))
        before = model.centres.copy()
        inertia = model.update(batch, F.col("w")) * batches / mass
        smooth.append(inertia if not smooth else smooth[-1] * (1 - alpha) + inertia * alpha)
        waited = 0 if smooth[-1] < best else waited + 1
        best = min(best, smooth[-1])
        if waited >= patience or 0 < tol >= float(((model.centres - before) ** 2).sum()):
            break
    return model.centres, smooth


def nearest_k_means(rows: DataFrame, n: int, rounds: int = 10, **options) -> np.ndarray:
    """Of each cluster the vector nearest to its centroid; the centroid where a cluster is empty."""
    centres = k_means(rows, n, rounds, **options)
    near = clusters.nearest(rows, centres).groupBy("cluster").agg(F.min_by("features", F.struct("distance", "id")).alias("v"))
    for r in near.collect():  # n rows
        centres[r["cluster"]] = r["v"]
    return centres


def k_medoids(rows: DataFrame, n: int, rounds: int = 10, candidates: int = 24) -> np.ndarray:
    """Vectors with a small summed distance of all rows to the nearest of them, by swaps.

    A round draws candidates and takes, in one pass over all rows, the exact cost of every swap of a medoid for a candidate;
    the best swap is made if it lowers the cost, else the search ends."""
    medoids = imprint(rows, n)
    for r in range(rounds):
        others = rows.orderBy(F.md5(F.concat_ws(":", F.lit("medoid"), F.lit(str(r)), F.col("id").cast("string"))), "id").limit(candidates)
        tried = np.array([x["features"] for x in others.select("features").collect()], float)  # candidates, at most

        def part(x: np.ndarray, medoids: np.ndarray = medoids, tried: np.ndarray = tried) -> np.ndarray:
            d, new = np.sqrt(clusters.squared_distances(x, medoids)), np.sqrt(clusters.squared_distances(x, tried))
            at = d.argmin(axis=1)
            first, rest = d[np.arange(len(x)), at], d.copy()
            rest[np.arange(len(x)), at] = np.inf
            with_all = np.minimum(new, first[:, None])
            own = np.zeros((len(x), n))
            own[np.arange(len(x)), at] = 1
            # where a row's own medoid goes, its second counts
            cost = with_all.sum(axis=0)[None] + own.T @ (np.minimum(new, rest.min(axis=1)[:, None]) - with_all)
            return np.concatenate([[first.sum()], cost.ravel()])

        got = np.round(sums.total(rows, part, 1 + n * len(tried)), DIGITS)
        best = int(got[1:].argmin())
        if got[1 + best] >= got[0]:
            break
        medoids = medoids.copy()
        medoids[best // len(tried)] = tried[best % len(tried)]
    return medoids


def local_contrast(rows: DataFrame, bias: float = 10 / 255**2) -> DataFrame:
    """The rows with the features of each less their mean, over sqrt(their population variance + bias)."""

    def contrast(x: np.ndarray) -> np.ndarray:
        x = x - x.mean(axis=1, keepdims=True)
        return x / np.sqrt((x * x).mean(axis=1, keepdims=True) + bias)

    return sums.applied(rows, contrast)


def coefficient_quality(coefficients: DataFrame) -> DataFrame:
    """(pos, quality): squares of the coefficients (class, pos, w), summed over classes."""
    return coefficients.groupBy("pos").agg(F.sum(F.col("w") * F.col("w")).alias("quality"))


def frame(spark: SparkSession, bank: np.ndarray) -> DataFrame:
    """(kernel, pos, w) of a bank of flat prototypes."""
    return spark.createDataFrame([(k, i, float(v)) for k, x in enumerate(bank) for i, v in enumerate(x)], "kernel int, pos int, w double")
