"""Loss aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.labels import fold_target, type_index
from glyphloom.functions.scores import cross_entropy, focal_factor, fold_case_scores, type_scores


def focal_loss(
    scored: DataFrame, weights: Column | None = None, smoothing: float = 0.0, gamma: float = 0.0
) -> DataFrame:
    """Plain mean of the weighted, smoothed cross-entropy times the focal factor."""

    row = cross_entropy(F.col("scores"), F.col("target"), weights, smoothing)
    return scored.agg(F.avg(row * focal_factor(F.col("scores"), F.col("target"), gamma)).alias("focal_loss"))


def weighted_loss(scored: DataFrame, weights: Column, smoothing: float = 0.0) -> DataFrame:
    """The same rows divided by the sum of the target weights."""

    row = cross_entropy(F.col("scores"), F.col("target"), weights, smoothing)
    return scored.agg((F.sum(row) / F.sum(F.element_at(weights, F.col("target") + 1))).alias("weighted_loss"))


def auxiliary_loss(scored: DataFrame, folded_weight: float, type_weight: float) -> DataFrame:
    """Case-folded and type cross-entropy of 62 scores, each with its weight."""

    return scored.agg(_auxiliary(folded_weight, type_weight).alias("auxiliary_loss"))


def _auxiliary(folded_weight: float, type_weight: float) -> Column:
    scores, target = F.col("scores"), F.col("target")
    total = F.lit(0.0)
    if folded_weight > 0:
        total = total + folded_weight * F.avg(cross_entropy(fold_case_scores(scores), fold_target(target)))
    if type_weight > 0:
        total = total + type_weight * F.avg(cross_entropy(type_scores(scores), type_index(target)))
    return total


def loss_report(
    scored: DataFrame, weights: Column, smoothing: float, gamma: float, folded_weight: float, type_weight: float
) -> DataFrame:
    """All three in one pass over the rows."""

    scores, target = F.col("scores"), F.col("target")
    row = cross_entropy(scores, target, weights, smoothing)
    return scored.agg(
        F.avg(row * focal_factor(scores, target, gamma)).alias("focal_loss"),
        (F.sum(row) / F.sum(F.element_at(weights, target + 1))).alias("weighted_loss"),
        _auxiliary(folded_weight, type_weight).alias("auxiliary_loss"),
    )
