"""Pluggable scorers and a distributed baseline classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[np.ndarray], np.ndarray]

# --- fixed values: hidden layers of the baseline --------------------------------------
HIDDEN_LAYERS = [768, 384]


def score_vectors(samples: DataFrame, scorer: Scorer, region: str = "region_id", vector: str = "vec") -> DataFrame:
    """(region, scores): run any batch function over the vectors, Arrow batch by batch.

    Filter the samples first: regions that need no score should not reach the scorer.
    """

    narrow = samples.select(region, F.col(vector).cast("array<double>").alias("_v"))
    region_type = dict(narrow.dtypes)[region]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = scorer(np.stack(batch["_v"].to_numpy()))
                yield pd.DataFrame({region: batch[region], "scores": list(np.asarray(scores, dtype=np.float64))})

    return narrow.mapInPandas(run, f"`{region}` {region_type}, scores array<double>")


def _features(samples: DataFrame, vector: str, label: str) -> DataFrame:
    return samples.select(
        "*", array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("_label"),
    )


def train_baseline(
    train: DataFrame,
    classes: int,
    hidden: list[int] | None = None,
    vector: str = "vec",
    label: str = "target",
    iterations: int = 60,
    seed: int = 42,
) -> MultilayerPerceptronClassificationModel:
    """Fit the two-hidden-layer network; the input layer follows the vector length."""

    width = train.select(F.size(vector).alias("n")).first()["n"]
    classifier = MultilayerPerceptronClassifier(
        layers=[width, *(HIDDEN_LAYERS if hidden is None else hidden), classes],
        featuresCol="features", labelCol="_label", maxIter=iterations, seed=seed,
    )
    return classifier.fit(_features(train, vector, label))


def baseline_predictions(model: MultilayerPerceptronClassificationModel, samples: DataFrame, id: str = "sample_id",
                         vector: str = "vec", label: str = "target") -> DataFrame:
    """(id, target, predicted_target)."""

    return model.transform(_features(samples, vector, label)).select(
        id, F.col(label).alias("target"), F.col("prediction").cast("int").alias("predicted_target")
    )


def train_best_baseline(
    train: DataFrame, validation: DataFrame, classes: int, seeds: list[int], hidden: list[int] | None = None,
    vector: str = "vec", label: str = "target", iterations: int = 60,
) -> tuple[MultilayerPerceptronClassificationModel, float]:
    """Fit once per seed and keep the model with the best validation accuracy (percent)."""

    evaluator = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="prediction", metricName="accuracy")
    best, best_accuracy = None, -1.0
    for seed in seeds:
        model = train_baseline(train, classes, hidden, vector, label, iterations, seed)
        accuracy = 100.0 * evaluator.evaluate(model.transform(_features(validation, vector, label)))
        if accuracy > best_accuracy:
            best, best_accuracy = model, accuracy
    return best, best_accuracy
