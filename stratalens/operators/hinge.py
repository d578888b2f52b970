"""Linear support vector machines of all classes at once.

Each class against the rest, as LinearSVC within OneVsRest: the mean hinge loss and half of reg times the squared weights. The
hinge's corner is rounded over a margin of CORNER, so that gradients lead to the end. All classes move in step: a pass over the
table gives the losses and gradients of all of them, so passes don't grow with classes, and only sums of the model's size travel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sums

CORNER = 0.02
#: Pairs of steps and changes of gradient that a class remembers.
MEMORY = 10
#: Lengths of step that a pass tries for each class, the best of which is taken; a class ends below the least.
STEPS, LEAST = (4.0, 1.0, 0.5, 0.2, 0.05, 0.01), 1e-5


def losses(rows: DataFrame, label: Column, w: np.ndarray, own: np.ndarray, reg: float, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of w (weights, then the intercept) the loss and its gradient, of the class in own."""
    k, d = w.shape[0], w.shape[1] - 1

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sign = np.where(y[:, None] == own, 1.0, -1.0)
        short = 1 - sign * (x @ w[:, :d].T + w[:, d])
        slope = np.clip(short / CORNER, 0, 1)
        g = -sign * slope
        return np.concatenate([[len(x)], (slope * (short - slope * CORNER / 2)).sum(axis=0), (g.T @ x).ravel(), g.sum(axis=0)])

    got = sums.total(rows, part, 1 + 2 * k + k * d, label, tasks=tasks)
    mean = got[1:] / got[0]
    slopes = np.concatenate([mean[k : k + k * d].reshape(k, d) + reg * w[:, :d], mean[k + k * d :][:, None]], axis=1)
    return mean[:k] + reg / 2 * (w[:, :d] ** 2).sum(axis=1), slopes


def _direction(g: np.ndarray, moved: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the inverse curvature, as remembered, times the gradient (limited-memory BFGS)."""
    q, shares = g.copy(), []
    for s, y in reversed(moved):
        shares.append(s @ q / (s @ y))
        q -= shares[-1] * y
    if moved:
        s, y = moved[-1]
        q *= s @ y / (y @ y)
    else:
        q /= max(1.0, np.linalg.norm(q))
    for (s, y), a in zip(moved, reversed(shares)):
        q += (a - y @ q / (s @ y)) * s
    return -q


def fit(rows: DataFrame, label: Column, classes: int, d: int, tasks: int, reg: float, passes: int, tol: float) -> np.ndarray:
    """A row of weights and the intercept for each class. A class is at its end when its gradient is tol times the first or less,
    or when no step lowers its loss."""
    w = np.zeros((classes, d + 1))
    f, g = losses(rows, label, w, np.arange(classes), reg, tasks)
    first = np.linalg.norm(g, axis=1)
    moved: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in w]
    share = np.ones(classes)
    for _ in range(passes):
        going = np.flatnonzero((np.linalg.norm(g, axis=1) > tol * first) & (share > LEAST))
        if not len(going):
            break
        ways = {c: _direction(g[c], moved[c]) for c in going}
        tried = np.array([w[c] + share[c] * t * ways[c] for c in going for t in STEPS])
        f2, g2 = losses(rows, label, tried, np.repeat(going, len(STEPS)), reg, tasks)
        for i, c in enumerate(going):
            j = i * len(STEPS) + int(f2[i * len(STEPS) : (i + 1) * len(STEPS)].argmin())
            if f2[j] >= f[c]:
                share[c] *= STEPS[-1]
                continue
            s, y = tried[j] - w[c], g2[j] - g[c]
            if s @ y > 1e-12 * (y @ y):
                moved[c] = [*moved[c], (s, y)][-MEMORY:]
            w[c], f[c], g[c], share[c] = tried[j], f2[j], g2[j], 1.0
    return w


class LinearSVM(Estimator, HasFeaturesCol, HasLabelCol):
    """Labels are 0, 1 and so on; a class without rows has every row against it. No rows and null labels are errors."""

    def __init__(self, reg: float = 0.01, passes: int = 40, tol: float = 1e-3):
        super().__init__()
        self.reg, self.passes, self.tol = reg, passes, tol

    def setFeaturesCol(self, value: str) -> LinearSVM:
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> LinearSVM:
        return self._set(labelCol=value)

    def _fit(self, dataset: DataFrame) -> LinearSVMModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("features"), F.col(self.getLabelCol()).cast("double").alias("label"))
        n, known, top = rows.agg(F.count("*"), F.count("label"), F.max("label")).first()
        if not n or known < n:
            raise ValueError("no samples" if not n else "samples without a label")
        with sums.held(rows) as kept:
            d = sums.dimension(kept)
            w = fit(kept, F.col("label"), int(top) + 1, d, sums.tasks(n, d), self.reg, self.passes, self.tol)
        return self._copyValues(LinearSVMModel(w))


class LinearSVMModel(Model, HasFeaturesCol, HasLabelCol):
    """Adds rawPrediction, the margins of the classes, and prediction, the first class of the largest."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        k, d = self.w.shape
        return DenseMatrix(k, d - 1, self.w[:, :-1].ravel(), True)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = self.w

        def margins(column: pa.Array) -> pa.Array:
            return sums.lists(sums.matrix(column) @ w[:, :-1].T + w[:, -1]) if len(column) else pa.array([], pa.list_(pa.float64()))

        out = dataset.withColumn("_m", F.arrow_udf(margins, "array<double>")(vector_to_array(self.getFeaturesCol())))
        best = (F.array_position("_m", F.array_max("_m")) - 1).cast("double")
        return out.withColumn("rawPrediction", array_to_vector("_m")).withColumn("prediction", best).drop("_m")
