"""Curation: unions of sources, caps, splits, weights and the exemplar bank."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions.labels import fold_target, is_alnum, is_alpha, is_digit, is_lower, is_upper
from glyphloom.functions.ranking import first_n, hash_number, hashed_head, hashed_rank, hashed_top, seeded_hash
from glyphloom.session import cut_lineage

# --- fixed values -------------------------------------------------------------------
VALIDATION_PERCENT = 15
SPLIT_SEED = 42
EXEMPLARS_PER_CLASS = 80


# ------------------------------------------------------------------ target remaps


def letters_split_targets(samples: DataFrame, offset: int = 0) -> DataFrame:
    """A 1-based letters split with an unused class 0, as 0-based targets plus ``offset``."""

    return samples.filter(F.col("target") > 0).withColumn("target", F.col("target") - 1 + offset)


def fold_source_targets(samples: DataFrame, source_vocab: DataFrame, vocab: DataFrame) -> DataFrame:
    """Targets of a 62-label source in the 36-label order, lower case folded into upper.

    Both vocabularies have (idx, label); labels that are not letters or digits drop out.
    """

    labels = source_vocab.filter(
        is_digit(F.col("label")) | ((F.length("label") == 1) & is_alpha(F.col("label")))
    )
    mapping = (
        labels.select(F.col("idx").alias("target"), F.upper("label").alias("label"))
        .join(vocab.select(F.col("idx").alias("folded"), "label"), "label")
        .select("target", "folded")
    )
    return samples.join(mapping, "target").drop("target").withColumnRenamed("folded", "target")


def vocabulary_order_errors(source_vocab: DataFrame, vocab: DataFrame) -> DataFrame:
    """Positions where a source's label order differs from the wanted prefix."""

    return vocab.select("idx", F.col("label").alias("wanted")).join(
        source_vocab.select("idx", F.col("label").alias("found")), "idx", "left"
    ).filter(~F.col("wanted").eqNullSafe(F.col("found")))


def keep_source_targets(samples: DataFrame, source_vocab: DataFrame, vocab: DataFrame) -> DataFrame:
    """Targets of a source that already follows the vocabulary; fails loudly when it does not."""

    wrong = vocabulary_order_errors(source_vocab, vocab).limit(1).collect()
    if wrong:
        raise ValueError(f"Unexpected source label order at position {wrong[0]['idx']}")
    return samples.join(vocab.select(F.col("idx").alias("target")), "target", "left_semi")


def fold_case_targets(samples: DataFrame) -> DataFrame:
    return samples.withColumn("target", fold_target(F.col("target")))


def target_range(samples: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows whose target lies in ``[start, stop)``."""

    return samples.filter((F.col("target") >= start) & (F.col("target") < stop))


def vocabulary_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """(side, idx, label) entries found on one side only; empty means equal."""

    a, b = first.select("idx", "label"), second.select("idx", "label")
    return (
        a.exceptAll(b).withColumn("side", F.lit("first"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
    )


def require_same_vocabulary(first: DataFrame, second: DataFrame) -> None:
    if vocabulary_differences(first, second).limit(1).collect():
        raise ValueError("Sample labels do not match the recognizer's labels.")


# ------------------------------------------------------------------ sampling


def cap_per_class(samples: DataFrame, n: int | None, seed: int, label: str = "target", id: str = "sample_id") -> DataFrame:
    """A seeded draw of at most ``n`` rows per class, with ``shuffle_key`` as the global order."""

    shuffle = seeded_hash(seed + 1_000_003, F.col(id))
    if n is None:
        return samples.withColumn("shuffle_key", shuffle)
    return hashed_top(samples, [label], seeded_hash(seed, F.col(id)), id, n).withColumn("shuffle_key", shuffle)


def stratified_split(
    samples: DataFrame,
    label: str = "target",
    id: str = "sample_id",
    percent: int = VALIDATION_PERCENT,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Adds ``split``: the first ``percent`` of each class in seeded order validate."""

    rows = F.col("_group_rows")
    take = F.floor((rows * percent + 50) / 100)
    flagged = hashed_head(samples, [label], seeded_hash(seed, F.col(id)), id, take)
    return flagged.withColumn("split", F.when(F.col("is_head"), "validation").otherwise("train")).drop("is_head")


def exemplar_bank(
    samples: DataFrame, n: int = EXEMPLARS_PER_CLASS, label: str = "target", order: str = "sample_id"
) -> DataFrame:
    """The first ``n`` samples of each class in source order, vectors as floats."""

    return first_n(samples, [label], [F.col(order)], n)


@dataclass(frozen=True)
class SourcePart:
    """One source of a union: its table, and whether and how it is capped."""

    name: str
    samples: DataFrame
    cap: int | None = None
    seed_step: int = 0
    enabled: bool = True


def union_sources(parts: list[SourcePart], seed: int, columns: list[str]) -> DataFrame:
    """Union of the enabled parts with a ``source`` column, each capped with its own seed."""

    frames = []
    for part in parts:
        if not part.enabled:
            continue
        frame = part.samples
        if part.cap is not None:
            frame = cap_per_class(frame, part.cap, seed + part.seed_step)
        frames.append(frame.select(*columns).withColumn("source", F.lit(part.name)))
    return reduce(DataFrame.unionByName, frames)


def first_seen(df: DataFrame, value: str, position: str, keys: list[str] | None = None) -> DataFrame:
    """Distinct values with the place they first appear, per group if ``keys`` are given."""

    return df.groupBy(*(keys or []), value).agg(F.min(position).alias("first_position"))


# ------------------------------------------------------------------ weights


def class_counts(samples: DataFrame, label: str = "target") -> DataFrame:
    return samples.groupBy(label).agg(F.count("*").alias("class_rows"))


def sample_weights(samples: DataFrame, label: str = "target") -> DataFrame:
    """Each row's inverse class frequency.

    The class table, one row per label, is written first: the join then knows its size
    and need not shuffle the samples.
    """

    return samples.join(cut_lineage(class_counts(samples, label)), label).withColumn(
        "weight", 1.0 / F.greatest(F.col("class_rows"), F.lit(1))
    )


def weighted_draw(samples: DataFrame, seed: int, label: str = "target", id: str = "sample_id") -> DataFrame:
    """As many draws as rows, with replacement, by inverse class frequency.

    Every class weighs the same in total, so a draw is a uniform class followed by
    a uniform row in it. Each row of the table carries one draw, and (class, rank)
    makes it an equi-join: no cumulative weights, no range join.
    """

    counts = cut_lineage(class_counts(samples, label))
    classes = counts.agg(F.count("*")).scalar()
    # One row per class, so numbering them needs no partitioning.
    numbered = counts.withColumn("_slot", F.row_number().over(W.orderBy(label)) - 1)
    class_pick = hash_number(seeded_hash(seed, F.col("draw_id"), F.lit("class")))
    row_pick = hash_number(seeded_hash(seed, F.col("draw_id"), F.lit("row")))
    picked = (
        samples.select(F.col(id).alias("draw_id"))
        .withColumn("_slot", F.pmod(class_pick, classes).cast("int"))
        .join(numbered, "_slot")
        .select("draw_id", label, (F.pmod(row_pick, F.col("class_rows")) + 1).alias("rank"))
    )
    ranked = hashed_rank(samples.select(id, label), [label], seeded_hash(seed, F.col(id)), id)
    return picked.join(ranked, [label, "rank"]).select("draw_id", id, label)


def _boost(label: Column, members: str, weight: float) -> Column:
    if not members:
        return F.lit(1.0)
    return F.when((F.length(label) == 1) & F.lit(members).contains(label), float(max(weight, 1.0))).otherwise(1.0)


def character_loss_weights(
    vocab: DataFrame, punctuation_weight: float = 1.0, weak_labels: str = "", weak_weight: float = 1.0
) -> DataFrame | None:
    """(idx, label, weight), or None when every boost is neutral."""

    if punctuation_weight <= 1.0 and (not weak_labels or weak_weight <= 1.0):
        return None
    label = F.col("label")
    base = F.when(~is_alnum(label), float(punctuation_weight)).otherwise(1.0)
    return vocab.select("idx", "label", (base * _boost(label, weak_labels, weak_weight)).alias("weight"))


def mixed_loss_weights(
    vocab: DataFrame,
    upper_weight: float = 1.0,
    lower_weight: float = 1.0,
    weak_labels: str = "",
    weak_weight: float = 1.0,
    counts: DataFrame | None = None,
    balance_strength: float = 0.0,
) -> DataFrame | None:
    """(idx, label, weight) with case and weak-label boosts and class balancing, or None.

    ``counts`` has (target, class_rows); a label without rows counts as one.
    """

    boosted = upper_weight > 1.0 or lower_weight > 1.0 or (bool(weak_labels) and weak_weight > 1.0)
    balanced = counts is not None and balance_strength > 0.0
    if not boosted and not balanced:
        return None
    label = F.col("label")
    case = (
        F.when(is_upper(label), float(max(upper_weight, 1.0)))
        .when(is_lower(label), float(max(lower_weight, 1.0)))
        .otherwise(1.0)
    )
    weight = case * _boost(label, weak_labels, weak_weight)
    if not balanced:
        return vocab.select("idx", "label", weight.alias("weight"))
    filled = vocab.join(counts.withColumnRenamed("target", "idx"), "idx", "left").withColumn(
        "_n", F.greatest(F.coalesce("class_rows", F.lit(0)), F.lit(1)).cast("double")
    )
    # The window spans the vocabulary only.
    mean = F.avg("_n").over(W.partitionBy(F.lit(1)))
    strength = min(max(float(balance_strength), 0.0), 1.0)
    return filled.select("idx", "label", (weight * F.pow(mean / F.col("_n"), F.lit(strength))).alias("weight"))
