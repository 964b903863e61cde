"""Accuracy breakdowns, confusions, gates and metric histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions.labels import (
    CHARACTER_GROUPS,
    MIXED_GROUPS,
    case_group,
    character_group,
    matches_ambiguous,
    matches_casefold,
    matches_visual,
    sequence_matches,
)
from glyphloom.functions.ranking import first_n

# --- fixed values: the saved-metric gates and their target --------------------------
GATE_TARGET = 95.0
SAVED_GATES = [
    ("digit_specialist_exact", "digit", "test_accuracy"),
    ("folded_alnum_exact", "folded", "test_accuracy"),
    ("mixedcase_exact", "mixedcase", "test_accuracy"),
    ("mixedcase_case_or_visual", "mixedcase", "case_or_ambiguity_aware_test_accuracy"),
    ("character_exact", "character", "validation_accuracy"),
    ("character_ambiguity", "character", "ambiguity_aware_validation_accuracy"),
    ("punctuation_exact", "character", "punctuation_validation_accuracy"),
    ("punctuation_ambiguity", "character", "punctuation_ambiguity_aware_validation_accuracy"),
]
EARLY_STOP_EPOCH = 8


def percent(correct: Column, total: Column) -> Column:
    """Share in percent; an empty total gives 0.0, not null."""

    return 100.0 * F.coalesce(correct, F.lit(0)) / F.greatest(total, F.lit(1))


def share(condition: Column, within: Column | None = None) -> Column:
    """Percent of rows, or of the rows ``within``, where the condition holds."""

    if within is None:
        return percent(F.count_if(condition), F.count("*"))
    return percent(F.count_if(condition & within), F.count_if(within))


def evaluation(scored: DataFrame, batch: str = "batch_id", loss: str = "loss", correct: str = "correct") -> DataFrame:
    """Loss as the mean of batch means, accuracy over all rows."""

    batches = scored.groupBy(batch).agg(
        F.avg(loss).alias("_loss"), F.count_if(F.col(correct)).alias("_ok"), F.count("*").alias("_n")
    )
    return batches.agg(
        F.coalesce(F.avg("_loss"), F.lit(0.0)).alias("loss"),
        percent(F.sum("_ok"), F.coalesce(F.sum("_n"), F.lit(0))).alias("accuracy"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
    )


def _pair_matches(scored: DataFrame) -> DataFrame:
    """Scored rows reduced to label pairs with their count, then matched once per pair."""

    pairs = scored.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    e, p = F.col("expected"), F.col("predicted")
    return pairs.select(
        "expected", "predicted", "n",
        (e == p).alias("exact"),
        matches_ambiguous(e, p, CHARACTER_GROUPS).alias("ambiguous"),
        matches_casefold(e, p).alias("casefold"),
        matches_visual(e, p, MIXED_GROUPS).alias("visual"),
        matches_ambiguous(e, p, MIXED_GROUPS).alias("case_or_visual"),
        character_group(e).alias("grp"),
        case_group(e).alias("case_grp"),
    )


def _rows(condition: Column | None = None) -> Column:
    if condition is None:
        return F.coalesce(F.sum("n"), F.lit(0))
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _pair_share(condition: Column, within: Column | None = None) -> Column:
    if within is None:
        return percent(_rows(condition), _rows())
    return percent(_rows(condition & within), _rows(within))


def character_breakdown(scored: DataFrame) -> DataFrame:
    """Exact and ambiguity-aware accuracy, exact per group, punctuation ambiguity-aware."""

    exact, ambiguous = F.col("exact"), F.col("ambiguous")
    of = lambda g: F.col("grp") == g
    return _pair_matches(scored).agg(
        _pair_share(exact).alias("validation_accuracy"),
        _pair_share(ambiguous).alias("ambiguity_aware_validation_accuracy"),
        _pair_share(exact, of("digits")).alias("digit_validation_accuracy"),
        _pair_share(exact, of("letters")).alias("letter_validation_accuracy"),
        _pair_share(exact, of("punctuation")).alias("punctuation_validation_accuracy"),
        _pair_share(ambiguous, of("punctuation")).alias("punctuation_ambiguity_aware_validation_accuracy"),
    )


def mixed_breakdown(scored: DataFrame) -> DataFrame:
    """Exact, casefold, strict visual and case-or-visual, and three of them per case group."""

    measures = [
        _pair_share(F.col("exact")).alias("test_accuracy"),
        _pair_share(F.col("casefold")).alias("casefold_test_accuracy"),
        _pair_share(F.col("visual")).alias("ambiguity_aware_test_accuracy"),
        _pair_share(F.col("case_or_visual")).alias("case_or_ambiguity_aware_test_accuracy"),
    ]
    for suffix, column in (
        ("test_accuracy", "exact"),
        ("ambiguity_aware_test_accuracy", "visual"),
        ("case_or_ambiguity_aware_test_accuracy", "case_or_visual"),
    ):
        for group in ("digit", "upper", "lower"):
            measures.append(_pair_share(F.col(column), F.col("case_grp") == group).alias(f"{group}_{suffix}"))
    return _pair_matches(scored).agg(*measures)


def label_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy of every label that occurs."""

    hit = F.col("expected") == F.col("predicted")
    return scored.groupBy(F.col("expected").alias("label")).agg(
        F.count_if(hit).alias("correct"), F.count("*").alias("total"), share(hit).alias("accuracy")
    )


def confusions(scored: DataFrame, group: Column | None = None) -> DataFrame:
    """How often each wrong pair occurs, with the group of the expected label."""

    grp = character_group(F.col("expected")) if group is None else group
    return (
        scored.filter(F.col("expected") != F.col("predicted"))
        .groupBy("expected", "predicted")
        .agg(F.count("*").alias("count"))
        .withColumn("grp", grp)
    )


def confusion_report(scored: DataFrame) -> DataFrame:
    """Total, group and label accuracy in one pass; ``level`` tells the three apart."""

    pairs = _pair_matches(scored).withColumnRenamed("expected", "label")
    grouped = pairs.groupingSets([[], [F.col("grp")], [F.col("grp"), F.col("label")]], F.col("grp"), F.col("label"))
    return grouped.agg(
        F.grouping_id().alias("_gid"),
        _rows().alias("total"),
        _rows(F.col("exact")).alias("correct"),
        _pair_share(F.col("exact")).alias("exact_accuracy"),
        _pair_share(F.col("ambiguous")).alias("ambiguity_aware_accuracy"),
    ).select(
        F.when(F.col("_gid") == 0, "label").when(F.col("_gid") == 1, "group").otherwise("total").alias("level"),
        "grp", "label", "total", "correct", "exact_accuracy", "ambiguity_aware_accuracy",
    )


def top_confusions(confused: DataFrame, k: int = 25) -> DataFrame:
    """Most frequent pairs overall; ties in (expected, predicted) order."""

    return confused.orderBy(F.desc("count"), "expected", "predicted").limit(k)


def top_confusions_by_group(confused: DataFrame, k: int = 25) -> DataFrame:
    return first_n(confused, ["grp"], [F.desc("count"), F.asc("expected"), F.asc("predicted")], k)


def worst_labels(accuracies: DataFrame, k: int = 25) -> DataFrame:
    """The least accurate labels that have support."""

    return accuracies.filter(F.col("total") > 0).orderBy("accuracy", "label").limit(k)


def hard_case_report(results: DataFrame) -> DataFrame:
    """(target, prediction, font) results, overall (font null) and per font."""

    judged = results.select(
        "font",
        (F.col("target") == F.col("prediction")).alias("exact"),
        sequence_matches(F.col("target"), F.col("prediction")).alias("aware"),
    )
    return judged.rollup("font").agg(
        F.grouping_id().alias("_gid"),
        F.count("*").alias("total"),
        F.count_if("exact").alias("exact_correct"),
        share(F.col("exact")).alias("exact_accuracy"),
        F.count_if("aware").alias("ambiguity_aware_correct"),
        share(F.col("aware")).alias("ambiguity_aware_accuracy"),
    ).withColumn("scope", F.when(F.col("_gid") == 1, "all").otherwise("font")).drop("_gid")


def replay_accuracy(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """Share of replay cases whose page text equals the correction; 0.0 without cases.

    ``cases``: image_id, target. ``pages``: image_id, sequence.
    """

    joined = cases.join(pages, "image_id", "left")
    hit = F.coalesce(F.col("sequence"), F.lit("")) == F.col("target")
    return joined.agg(
        F.count("*").alias("total"), F.count_if(hit).alias("correct"), share(hit).alias("accuracy")
    )


def best_checkpoint(candidates: DataFrame, metric: str, keys: list[str] | None = None) -> DataFrame:
    """The candidate with the highest metric; a missing metric counts as 0, the earliest wins a tie.

    ``candidates`` carries ``position``, the place in its history. With ``kind`` the
    history comes first, then ``best_checkpoint``, then other checkpoints by name.
    """

    value = F.coalesce(F.col(metric), F.lit(0.0))
    kind = F.col("kind") if "kind" in candidates.columns else F.lit("history")
    rank = F.when(kind == "history", 0).when(kind == "best_checkpoint", 1).otherwise(2)
    first = F.struct((-value).alias("v"), rank.alias("r"), kind.alias("k"), F.col("position").alias("p"))
    picked = candidates.groupBy(*(keys or [])).agg(F.min_by(F.struct(*candidates.columns), first).alias("b"))
    return picked.select("b.*")


def gate_definitions(spark: SparkSession, gates: list[tuple[str, str, str]] = SAVED_GATES) -> DataFrame:
    return spark.createDataFrame(gates, "name string, model string, metric string")


def quality_gates(definitions: DataFrame, metrics: DataFrame, target: float = GATE_TARGET) -> DataFrame:
    """Pass or fail of each gate on (model, metric, value); a missing value fails."""

    joined = definitions.join(metrics, ["model", "metric"], "left")
    return joined.select(
        "name", F.col("value").cast("double").alias("value"), F.lit(float(target)).alias("target"),
        F.coalesce(F.col("value") >= target, F.lit(False)).alias("passed"),
    )


def hard_case_gates(report: DataFrame, target: float = GATE_TARGET) -> DataFrame:
    """The two counted gates from the overall row of :func:`hard_case_report`."""

    rows = F.array(
        F.struct(
            F.lit("app_hardcase_exact").alias("name"), F.col("exact_accuracy").alias("value"),
            F.col("exact_correct").alias("correct"),
        ),
        F.struct(
            F.lit("app_hardcase_ambiguity").alias("name"), F.col("ambiguity_aware_accuracy").alias("value"),
            F.col("ambiguity_aware_correct").alias("correct"),
        ),
    )
    return report.filter(F.col("scope") == "all").select(F.explode(rows).alias("g"), "total").select(
        "g.name", "g.value", F.lit(float(target)).alias("target"),
        F.coalesce(F.col("g.value") >= target, F.lit(False)).alias("passed"), "g.correct", "total",
    )


def training_progress(
    history: DataFrame, metric: str, train_metric: str, target: float, min_epoch: int = EARLY_STOP_EPOCH
) -> DataFrame:
    """Per model and epoch: best so far, whether it improved, the gap, and the stop epoch."""

    before = W.partitionBy("model").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    best_before = F.max(metric).over(before)
    stop = F.min(F.when((F.col(metric) >= target) & (F.col("epoch") >= min_epoch), F.col("epoch")))
    return history.select(
        "model", "epoch", metric,
        F.greatest(F.col(metric), best_before).alias("best_so_far"),
        (best_before.isNull() | (F.col(metric) > best_before)).alias("improved"),
        (F.col(train_metric) - F.col(metric)).alias("overfit_gap"),
        stop.over(W.partitionBy("model")).alias("stop_epoch"),
    )
