"""Learners over tables of vectors: against plain numpy over all rows, planted structure, and skewed or small tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import clusters, factors, learn, learners, prototypes, sums
from stratalens.operators.draws import draw


def table(spark, x, parts=3):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>").repartition(parts)


def blobs(n=600, k=6, d=5, seed=1):
    """Clusters of very unlike sizes, one of a third of all rows."""
    draw_ = np.random.default_rng(seed)
    centres = draw_.normal(0, 20, (k, d))
    own = np.where(draw_.random(n) < 1 / 3, 0, draw_.integers(0, k, n))
    return centres[own] + draw_.normal(size=(n, d)), centres


def inertia(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_sums_over_batches_and_tasks(spark):
    x = np.random.default_rng(0).normal(100, 1, (5000, 4))
    rows = table(spark, x, 7)
    n, total, outer = sums.gram(rows)
    assert n == 5000 and np.allclose(total, x.sum(axis=0)) and np.allclose(outer, x.T @ x)
    mean, c = sums.covariance(rows)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(c, np.cov(x, rowvar=False, ddof=0), atol=1e-9)
    with pytest.raises(ValueError):
        sums.covariance(rows.limit(0))
    with pytest.raises(Exception, match="one length"):
        sums.gram(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, features array<double>").coalesce(1))


def test_whitening_of_tables(spark):
    x = np.random.default_rng(3).normal(size=(2000, 6)) @ np.random.default_rng(4).normal(size=(6, 6))
    rows = table(spark, x)
    w = factors.Whitening.fit(rows, 0.0)
    _, c = sums.covariance(w.transform(rows))
    assert np.allclose(c, np.eye(6), atol=1e-6)
    back = {r["id"]: r["features"] for r in w.inverse(w.transform(rows)).collect()}
    assert np.allclose([back[k] for k in range(len(x))], x)


def test_ica_recovers_sources(spark):
    draw_ = np.random.default_rng(5)
    sources = np.stack([draw_.laplace(size=4000), draw_.uniform(-1, 1, 4000), draw_.exponential(size=4000)], axis=1)
    mixing = draw_.normal(size=(3, 8))
    found = factors.ica(table(spark, sources @ mixing + 7), 3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    alike = np.abs(unit(found) @ unit(mixing).T)
    assert (alike.max(axis=1) > 0.99).all() and sorted(alike.argmax(axis=1).tolist()) == [0, 1, 2]
    with pytest.raises(ValueError):
        factors.ica(table(spark, sources @ mixing), 5)


def test_sparse_pca_finds_planted_directions(spark):
    draw_ = np.random.default_rng(6)
    x = draw_.normal(0, 0.3, (3000, 12))
    x[:, :3] += draw_.normal(0, 5, (3000, 1))
    x[:, 6:8] += draw_.normal(0, 3, (3000, 1))
    a, b = factors.sparse_pca(table(spark, x), 2, penalty=0.2)
    assert np.flatnonzero(np.abs(a) > 1e-9).tolist() == [0, 1, 2] and np.flatnonzero(np.abs(b) > 1e-9).tolist() == [6, 7]


def test_nmf_lowers_the_loss_over_all_rows(spark):
    draw_ = np.random.default_rng(7)
    x = draw_.random((800, 3)) @ draw_.random((3, 10)) ** 4
    h, losses = factors.nmf(table(spark, x), 3, rounds=15, tol=0.0)
    assert h.shape == (3, 10) and (h >= 0).all()
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:])) and losses[-1] < 0.02
    w = factors.row_factors(x, h, 20)
    assert ((x - w @ h) ** 2).sum() / (x**2).sum() == pytest.approx(losses[-1], abs=0.01)
    with pytest.raises(ValueError):
        factors.nmf(table(spark, x - 1), 3)


def test_cluster_sums(spark):
    x, centres = blobs(500)
    rows = table(spark, x)
    total, mass, cost = clusters.cluster_sums(rows, centres, F.col("id") % 3 + 1)
    w, near = np.arange(500) % 3 + 1, ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(mass, np.bincount(near, w, 6)) and np.allclose(total, [(x[near == k] * w[near == k, None]).sum(axis=0) for k in range(6)])
    assert cost == pytest.approx((((x - centres[near]) ** 2).sum(axis=1) * w).sum())


def test_spread_starts(spark):
    x, _ = blobs()
    rows = table(spark, x)
    spread, first = learners.spread(rows, 6), learners.imprint(rows, 6)
    assert spread.shape == (6, 5) and inertia(x, spread) < inertia(x, first) / 2
    assert np.array_equal(spread, learners.spread(rows.repartition(5), 6))  # whatever the partitions
    assert learners.spread(table(spark, np.ones((9, 2))), 3).shape == (3, 2)  # rows that repeat
    with pytest.raises(ValueError):
        learners.spread(rows.limit(2), 3)


def test_mini_batch_steps(spark):
    x, _ = blobs(400)
    rows, start = table(spark, x), x[:4]
    model = learners.mini_batch_steps(rows, start, batches=3, count=4, weight=F.col("id") % 2 + 1)
    centres, counts = start.copy(), np.zeros(4)
    batch, w = np.array([int(draw("batch", k) * 3) for k in range(400)]), np.arange(400) % 2 + 1.0
    for s in range(4):
        own = batch == s % 3
        near = ((x[own][:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(4):
            mine = w[own][near == k]
            if mine.sum():
                centres[k] = (centres[k] * counts[k] + (x[own][near == k] * mine[:, None]).sum(axis=0)) / (counts[k] + mine.sum())
                counts[k] += mine.sum()
    assert np.allclose(model.centres, centres) and np.allclose(model.counts, counts)


def test_mini_batch_ends_near_the_clusters(spark):
    x, centres = blobs()
    found, smooth = learners.mini_batch(table(spark, x), 6, batches=4, rounds=6, patience=5)
    assert inertia(x, found) < 1.3 * inertia(x, centres) and smooth[-1] < smooth[0] and len(smooth) <= 24
    sphered, _ = learners.mini_batch(table(spark, x), 3, batches=2, rounds=1, sphered=True)
    assert np.allclose(np.linalg.norm(sphered, axis=1), 1)


def test_low_counts_are_dealt_anew(spark):
    x, _ = blobs()
    model = learners.MiniBatch(np.concatenate([x[:3], np.full((1, 5), 1e6)]), [50, 40, 60, 0])
    assert model.deal_anew(table(spark, x), 3) == 1
    assert (x == model.centres[3]).all(axis=1).any() and model.counts[3] == 0 and np.array_equal(model.centres[:3], x[:3])
    # rows that lie at their centroid are likelier than those that lie far from it
    far = np.concatenate([np.zeros((50, 1)), np.full((1, 1), 9.0)])
    drawn = [learners.MiniBatch([[0.0], [1e9]], [50, 0]) for _ in range(8)]
    for turn, m in enumerate(drawn):
        m.deal_anew(table(spark, far, 1), turn)
    assert all(m.centres[1, 0] == 0 for m in drawn)


def test_k_medoids_over_all_rows(spark):
    x, centres = blobs(400)
    rows = table(spark, x)
    found = learners.k_medoids(rows, 6, rounds=8, candidates=40)
    cost = lambda c: np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2)).min(axis=1).sum()
    assert all((x == m).all(axis=1).any() for m in found) and cost(found) < 1.5 * cost(centres) and cost(found) <= cost(learners.imprint(rows, 6))


def test_knn_tiles(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TILE", 70)
    draw_ = np.random.default_rng(8)
    x, y = draw_.normal(size=(300, 4)), draw_.normal(size=(500, 4))
    y[100:200] = y[0]  # a fifth of the reference set is one vector
    known = table(spark, y).withColumn("q", (F.col("id") % 7).cast("double"))
    got = {r["id"]: [(n["id"], n["value"]) for n in r["near"]] for r in clusters.knn(table(spark, x), known, "q", 5).collect()}
    d = np.round(((x[:, None] - y[None]) ** 2).sum(axis=2), clusters.DIGITS)
    want = {k: [(int(j), float(j % 7)) for j in np.lexsort((np.arange(500), d[k]))[:5]] for k in range(300)}
    assert got == want
    mean = {r["id"]: r["q"] for r in clusters.knn_mean(table(spark, x), known.limit(3), "q", 5).collect()}
    assert len(mean) == 300  # fewer known rows than neighbours asked for


def test_knn_sends_rows_once(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TILE", 70)
    rows = table(spark, np.random.default_rng(8).normal(size=(400, 4))).withColumn("q", F.lit(1.0))
    plan = clusters.knn(rows, rows, "q", 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # no copies of rows for each tile of the other side
    assert clusters.knn(rows.limit(0), rows, "q", 5).count() == 0 and clusters.knn(rows, rows.limit(0), "q", 5).count() == 0


def test_algorithms_by_name(spark):
    x = np.random.default_rng(2).random((60, 25))
    rows = table(spark, x).persist()
    for name in prototypes.ALGORITHMS:
        bank = prototypes.learned(name, 4, rows, (1, 5, 5))
        assert bank.shape == (4, 1, 5, 5) and np.allclose((bank**2).sum(axis=(1, 2, 3)), 1)
    with pytest.raises(ValueError):
        prototypes.resolve("nonsense")
    for wrong in (lambda n, p: p[: n - 1], lambda n, p: p[:n, :, :4], lambda n, p: p[:n] * np.nan):
        with pytest.raises(ValueError):
            prototypes.learned(wrong, 4, rows, (1, 5, 5))
    assert np.allclose(prototypes.learned(lambda n, p: p[:n], 2, rows, (1, 5, 5))[0].ravel(), x[0] / np.linalg.norm(x[0]))


def test_weighted_kmeans_minds_weights(spark):
    rows = spark.createDataFrame([(0, [0.0], 1.0), (1, [1.0], 1.0), (2, [10.0], 2.0)], "id long, features array<double>, w double")
    assert prototypes.kmeans(rows, 1, weight=F.col("w"))[0, 0] == pytest.approx(21 / 4)


def test_use_weights(spark):
    x = np.random.default_rng(6).random((30, 2, 4, 4))
    coefficients = np.random.default_rng(7).random((3, 30))
    rows = table(spark, x[:3].reshape(3, -1))
    got = {r["id"]: r["w"] for r in prototypes.use_weights(rows, x, coefficients, 1).collect()}
    assert [got[k] for k in range(3)] == pytest.approx(((coefficients**2).sum(axis=0)[:3]).tolist())


def test_contrast_of_long_vectors(spark):
    x = np.random.default_rng(11).normal(3, 2, (60, 400))
    began = time.time()
    got = {r["id"]: r["features"] for r in learners.local_contrast(table(spark, x)).collect()}
    assert time.time() - began < 30  # work in proportion to the length; by its cube, minutes
    want = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 10 / 255**2)
    assert np.allclose([got[k] for k in range(len(x))], want)


def test_svm_fits_all_classes_in_the_same_passes(spark):
    from pyspark.ml.classification import LinearSVC, OneVsRest

    draw_, k = np.random.default_rng(12), 8
    own = draw_.integers(0, k, 600)
    x = draw_.normal(0, 3, (k, 5))[own] + draw_.normal(size=(600, 5)) * 2
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, own))], "image_id long, features array<double>, label int").repartition(3)
    spark.sparkContext.setJobGroup("svm", "svm")
    try:
        model = learn.fit(rows, "svm")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("svm")) < 250
    z, sign = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.where(own[:, None] == np.arange(k), 1, -1)
    loss = lambda w: (np.maximum(0, 1 - sign * (z @ w[:, :-1].T + w[:, -1])).mean(axis=0) + 0.005 * (w[:, :-1] ** 2).sum(axis=1)).sum()
    other = learn.fit(rows, OneVsRest(classifier=LinearSVC(maxIter=100, regParam=0.01), parallelism=4)).stages[-1]
    assert loss(model.stages[-1].w) < 1.02 * loss(np.array([[*m.coefficients.toArray(), m.intercept] for m in other.models]))
    found = learn.predict(model, rows).toPandas().sort_values("image_id")
    margins = z @ model.stages[-1].w[:, :-1].T + model.stages[-1].w[:, -1]
    assert np.allclose(np.stack(found["margins"]), margins) and (found["prediction"] == margins.argmax(axis=1)).all()
    assert learn.coefficients(model).shape == (k, 5)
    with pytest.raises(ValueError):
        learn.fit(rows.withColumn("label", F.when(F.col("image_id") > 3, F.col("label"))), "svm")
