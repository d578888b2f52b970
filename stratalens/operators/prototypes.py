"""Prototype algorithms by name, for a session: they learn from a table of patches of one shape.

Patches are rows (id, features array<double>, and for weighted learners w). Learners read the table as learners and factors do; a
caller's own function is given the patches drawn, which the caller has asked for a number of, as an array (samples, *shape)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import unit
from . import clusters, factors, learners, sums

Learner = Callable[..., np.ndarray]


def normed(bank: np.ndarray) -> np.ndarray:
    return np.array([unit(x) for x in bank])


def kmeans(rows: DataFrame, n: int, rounds: int | None = 50, weight: Column | None = None, tol: float = 1e-4) -> np.ndarray:
    return learners.k_means(rows, n, rounds, weight, learners.scale_free(rows, tol), "spread")


def contrast_kmeans(rows: DataFrame, n: int, whiten: bool = True, unwhiten: bool = True, floor: float = 0.1, rounds: int | None = None) -> np.ndarray:
    """k-means of patches of normed contrast, whitened, until the centroids stay; prototypes are brought back."""
    rows = learners.local_contrast(rows)
    if not whiten:
        with sums.held(rows.select("id", "features")) as kept:
            return kmeans(kept, n, rounds)
    w = factors.Whitening.fit(rows, floor)
    with sums.held(w.transform(rows).select("id", "features")) as kept:
        out = kmeans(kept, n, rounds)
    return out @ w.back + w.mean if unwhiten else out


ALGORITHMS: dict[str, Learner] = {
    "imprint": learners.imprint,
    "shuffle": learners.shuffle,
    "uniform": lambda rows, n, **more: learners.uniform(n, sums.dimension(rows), **more),
    "norm": lambda rows, n: learners.normal(rows, n, sums.dimension(rows)),
    "normal": lambda rows, n: learners.normal(rows, n, sums.dimension(rows)),
    "histogram": lambda rows, n, **more: learners.histogram(rows, n, sums.dimension(rows), **more),
    "kmeans": kmeans,
    "minibatch_kmeans": lambda rows, n, **more: learners.mini_batch(rows, n, **more)[0],
    "nearest_kmeans": lambda rows, n, rounds=50: learners.nearest_k_means(rows, n, rounds, start="spread"),
    "kmedoids": learners.k_medoids,
    "contrast_kmeans": contrast_kmeans,
    "ica": factors.ica,
    "pca": lambda rows, n: factors.pca(rows, n)[0],
    "sparse_pca": factors.sparse_pca,
    "nmf": lambda rows, n, **more: factors.nmf(rows, n, **more)[0],
}
#: k-means of patches that weigh by masks or by their use to a classifier; the session finds the weights.
WEIGHTED = {"object_mask_wkmeans": "mask", "omwkmeans": "mask", "meta_feature_wkmeans": "use", "mfwkmeans": "use"}


def resolve(name: str | Learner) -> Learner:
    """A learner over a table (rows, n); a caller's own function stays as it is."""
    if callable(name):
        return name
    try:
        return ALGORITHMS[name.lower()]
    except KeyError:
        raise ValueError(f"no prototype algorithm {name}; there are {', '.join(sorted(ALGORITHMS))}") from None


def arrays(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The patches drawn, in order of their ids."""
    held = rows.orderBy("id").select("features").collect()  # as many as the caller has asked for
    return np.array([r["features"] for r in held], float).reshape(-1, *shape)


def learned(algorithm: str | Learner, n: int, rows: DataFrame, shape: tuple[int, ...], **options) -> np.ndarray:
    """n prototypes of a shape, normed; a learner must give n of them, of numbers."""
    learner = resolve(algorithm)
    bank = np.asarray(learner(n, arrays(rows, shape), **options) if callable(algorithm) else learner(rows, n, **options).reshape(-1, *shape))
    if bank.shape != (n, *shape):
        raise ValueError(f"the learner gave prototypes of shape {bank.shape} instead of {(n, *shape)}")
    if not np.isfinite(bank).all():
        raise ValueError("the learner gave prototypes that aren't numbers")
    return normed(bank)


def meta_features(patches: np.ndarray) -> np.ndarray:
    """For each band of a patch the mean, the deviation, the extremes and the 0.3 and 0.7 quantiles (plotting positions 0.4)."""
    flat = np.sort(patches.reshape(*patches.shape[:2], -1).astype(float), axis=2)
    n = flat.shape[2]

    def quantile(p: float) -> np.ndarray:
        place = n * p + 0.4 + p * 0.2
        k = int(np.floor(min(max(place, 1), n - 1)))
        share = min(max(place - k, 0.0), 1.0)
        return (1 - share) * flat[:, :, k - 1] + share * flat[:, :, min(k, n - 1)]

    parts = [flat.mean(axis=2), flat.std(axis=2), flat[:, :, 0], flat[:, :, -1], quantile(0.3), quantile(0.7)]
    return np.stack(parts, axis=2).reshape(len(patches), -1)


def use_weights(rows: DataFrame, known: np.ndarray, coefficients: np.ndarray, k: int = 4) -> DataFrame:
    """rows with w: how much a classifier uses like features. The mean, over the k known patches of the nearest meta-features, of
    the summed squared coefficients of their features."""
    bands, side = known.shape[1:3]
    quality = (coefficients**2).sum(axis=0)
    table = rows.sparkSession.createDataFrame([(i, m.tolist(), float(q)) for i, (m, q) in enumerate(zip(meta_features(known), quality))], "id long, features array<double>, w double")
    meta = sums.applied(rows.select("id", "features"), lambda x: meta_features(x.reshape(-1, bands, side, side)))
    return rows.join(clusters.knn_mean(meta, table, "w", k), "id")


def mask_weights(rows: DataFrame, ratios: DataFrame, base: float = 0.0) -> DataFrame:
    """rows with w: the share of foreground in their receptive fields (box_id, ratio), and base more."""
    return rows.join(ratios.select(F.col("box_id").alias("id"), (F.col("ratio") + base).alias("w")), "id")
