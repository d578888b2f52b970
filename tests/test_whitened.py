"""Whitened k-means goes on until its centroids stay."""

import numpy as np
import pytest

from stratalens import learner_queries
from stratalens.operators import factors, learners, prototypes
from stratalens.queries import vectors


def moved(x, c):
    """Squared way of the centroids in one more step, and the elements' mean variance."""
    own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    after = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
    return ((after - c) ** 2).sum(), x.var(axis=0).mean()


def whitened(rows):
    rows = learners.local_contrast(rows)
    w = factors.Whitening.fit(rows)
    return w, np.array([r["features"] for r in w.transform(rows).collect()])


def test_query_goes_to_its_end(spark):
    d = "/root/testdata/sf0.01"
    w, x = whitened(vectors(spark, d))
    c = np.zeros((learner_queries.N, learner_queries.SIZE))
    for r in learner_queries.learn_whitened_kmeans(spark, d).collect():
        c[r["kernel"], r["pos"]] = r["w"]
    gap, variance = moved(x, (c - w.mean) @ w.forth)
    assert gap <= 2e-4 * variance


def test_more_than_fifty_steps(spark):
    """Two centroids that start at one end of a long even row move on by little in each of many steps."""
    x = np.linspace(0, 1, 4000)[:, None] ** 3
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>").coalesce(1).cache()
    starts, tol = x[:8], 1e-7 * float(x.var())
    few, end = learners.steps(rows, starts, 50, tol=tol), learners.steps(rows, starts, None, tol=tol)
    assert moved(x, few)[0] > tol >= moved(x, end)[0]


@pytest.mark.parametrize("value", [1.0, float("nan")])
def test_ends_on_equal_vectors_and_on_none_that_are_numbers(spark, value):
    rows = spark.createDataFrame([(k, [value, value]) for k in range(20)], "id long, features array<double>")
    assert learners.steps(rows, np.ones((2, 2)), None).shape == (2, 2)
    if value == 1.0:
        assert prototypes.contrast_kmeans(rows, 2).shape == (2, 2)
