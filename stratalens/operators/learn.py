"""Classifiers on feature rows (label int, features array<double>), by pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import analysis, corpus, hinge

LEARNERS: dict[str, Callable[[], object]] = {
    "svm": lambda: hinge.LinearSVM(reg=0.01),
    "logreg": lambda: LogisticRegression(maxIter=100, regParam=0.01),
    "slogreg": lambda: LogisticRegression(maxIter=100, regParam=0.01, elasticNetParam=1.0),
}
SCORES = ("accuracy", "auc")


def resolve_learner(learner):
    """A name, or an estimator as it is; never code to evaluate."""
    if not isinstance(learner, str):
        return learner
    if learner.lower() not in LEARNERS:
        raise ValueError(f"no learner {learner}; there are {', '.join(sorted(LEARNERS))}")
    return LEARNERS[learner.lower()]()


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw", array_to_vector("features")).withColumn("label", F.col("label").cast("double")).drop("features")


def fit(rows: DataFrame, learner="svm", scale: bool = True) -> PipelineModel:
    """Features are brought to mean 0 and deviation 1 first."""
    algorithm = resolve_learner(learner)
    algorithm.setFeaturesCol("features").setLabelCol("label")
    scaler = StandardScaler(withMean=scale, withStd=scale, inputCol="raw", outputCol="features")
    data = _vectors(rows).persist()  # each class and each step reads it again
    try:
        return Pipeline(stages=[scaler, algorithm]).fit(data)
    finally:
        data.unpersist()


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with prediction and, where the learner has them, margins."""
    out = model.transform(_vectors(rows)).withColumn("label", F.col("label").cast("int")).withColumn("prediction", F.col("prediction").cast("int"))
    if "rawPrediction" in out.columns:
        out = out.withColumn("margins", vector_to_array("rawPrediction"))
    return out.drop("raw", "features", "rawPrediction", "probability")


def linear(rows: DataFrame, weights, intercepts) -> DataFrame:
    """rows with the margins of a given linear model (a row of weights for each class) and prediction, the first class of the largest."""
    table = F.array(*(F.struct(F.array(*(F.lit(float(v)) for v in w)).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, intercepts, strict=True)))
    dot = lambda t: F.aggregate(F.zip_with(t["w"], F.col("features"), lambda a, x: a * x), F.lit(0.0), lambda s, v: s + v) + t["b"]
    out = rows.withColumn("margins", F.transform(table, dot))
    best = F.array_max(F.transform("margins", lambda m, k: F.struct(F.round(m, 9).alias("m"), (-k).alias("k"))))
    return out.withColumn("prediction", -best["k"])


def coefficients(model: PipelineModel) -> np.ndarray:
    """A row of coefficients for each class of a fitted linear classifier."""
    last = model.stages[-1]
    models = getattr(last, "models", None)
    if models is not None:
        return np.array([m.coefficients.toArray() for m in models])
    return last.coefficientMatrix.toArray()


def score_classifier(rows: DataFrame, model: PipelineModel | None = None, score_func: str | Callable = "accuracy", learner="svm", key: str = "image_id") -> float:
    """How well a model tells the rows' labels; without one, a learner fitted on half of each class is scored on the rest."""
    if model is None:
        return train_and_test(rows.drop("is_train"), learner, score_func, 0.5, key)["score"]
    return score(predict(model, rows), score_func)


def score(predictions: DataFrame, score_func: str | Callable = "accuracy") -> float:
    if callable(score_func):
        return float(score_func(predictions))
    if score_func == "accuracy":
        return analysis.accuracy(predictions, "label", "prediction").first()["accuracy"]
    if score_func == "auc":
        return analysis.auc(predictions.withColumn("_s", F.element_at("margins", -1)), "label", "_s").first()["auc"]
    raise ValueError(f"no score {score_func}; there are {', '.join(SCORES)}")


def train_and_test(rows: DataFrame, learner="svm", score_func: str | Callable = "accuracy", train_size: float = 0.5, key: str = "image_id") -> dict:
    """Splits by is_train where there is such a column, else by class; returns the scores, the model and predictions."""
    if "is_train" not in rows.columns:
        rows = corpus.choose_training(rows, "label", key, train_size)
    least = rows.where("is_train").groupBy("label").count().agg(F.min("count"), F.count("*")).first()
    if not least[0] or least[1] < 2:
        raise ValueError("training needs rows of two classes at least")
    model = fit(rows.where("is_train"), learner)
    found = predict(model, rows)
    return {"model": model, "predictions": found, "training_score": score(found.where("is_train"), score_func), "score": score(found.where(~F.col("is_train")), score_func)}


def cross_validate(rows: DataFrame, learner="svm", k: int = 10, score_func: str | Callable = "accuracy", key: str = "image_id") -> list[float]:
    """The scores of k stratified folds."""
    if rows.count() < k:
        raise ValueError("fewer rows than folds")
    dealt = corpus.folds(rows, "label", key, k)
    return [score(predict(fit(dealt.where(F.col("fold") != i), learner), dealt.where(F.col("fold") == i)), score_func) for i in range(k)]
