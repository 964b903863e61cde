"""Deciding one label per region from several recognizers and the glyph's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.labels import case_twins, is_alnum, is_alpha, is_digit, is_lower
from glyphloom.functions.predictions import case_pair, compact_guesses, empty_guesses, guesses_or_empty
from glyphloom.operators.matching import apply_fallback

# --- fixed values: digit against letter, (digit, letter, digit at least, letter below) --
DIGIT_OVER_LETTER = [
    ("2", "Z", 0.985, 0.97),
    ("4", "Y", 0.950, 0.995),
    ("5", "J", 0.950, 0.995),
    ("1", "I", 0.995, 0.98),
    ("1", "L", 0.995, 0.98),
    ("1", "l", 0.995, 0.98),
    ("0", "O", 0.995, 0.97),
    ("0", "o", 0.995, 0.97),
    ("8", "B", 0.995, 0.97),
    ("5", "S", 0.995, 0.97),
]
DIGIT_AMBIGUOUS = list("BIJLOSYZlo")
SHAPE_CONFIDENCE = 0.92
FOUR_CANDIDATES = ["4", "A", "Y"]
SEVEN_CANDIDATES = ["1", "7", "I", "L", "l"]
ONE_CANDIDATES = ["1", "I", "L", "l"]

# Columns :func:`arbitrate` reads; every recognizer but the first may be null.
SCORE_COLUMNS = [
    "label", "confidence", "punctuation", "exemplar_label", "distance", "letter_label", "letter_confidence",
    "alnum_label", "alnum_confidence", "alnum_alternatives", "digit_label", "digit_confidence",
    "like_four", "like_seven", "like_one",
]


def gather_scores(regions: DataFrame, tables: list[DataFrame], region: str = "region_id") -> DataFrame:
    """Left-join the score tables of the recognizers that looked at each region.

    Costly recognizers only score the regions that need them, so a missing row
    is normal. All joins share the region key and hence one partitioning.
    """

    out = regions
    for table in tables:
        out = out.join(table, region, "left")
    for name in SCORE_COLUMNS:
        if name not in out.columns:
            kind = (
                "array<struct<label:string,confidence:double>>" if name == "alnum_alternatives"
                else "boolean" if name.startswith("like_")
                else "double" if "confidence" in name or name == "distance"
                else "string"
            )
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def wants_letter_score(width: Column, height: Column, label: Column, confidence: Column) -> Column:
    """Whether a region is worth asking the letter recognizer about."""

    w, h = F.greatest(F.lit(1), width), F.greatest(F.lit(1), height)
    aspect = w / h
    return (
        is_alpha(label)
        | (label.isin("-", "_", "|", "1", "I", "l") & (aspect >= 0.28))
        | ((confidence < 0.82) & (aspect >= 0.32) & (w * h >= 650))
    )


def wants_digit_score(width: Column, height: Column, label: Column, confidence: Column) -> Column:
    """Whether the digit recognizer may rescue a doubtful, large enough region."""

    doubtful = ~is_alpha(label) | (confidence < 0.86) | label.isin(*DIGIT_AMBIGUOUS)
    return doubtful & (width >= 20) & (height >= 34) & (width * height >= 900)


def _alnum_wins(label: Column, conf: Column, new: Column, new_conf: Column, letter_conf: Column) -> Column:
    margin = F.when(is_lower(label), 0.18).otherwise(0.10)
    same_class = (is_digit(label) & is_digit(new)) | (is_alpha(label) & is_alpha(new))
    return (
        F.when(new_conf < 0.55, False)
        .when(is_digit(new) & (letter_conf >= 0.9), False)
        .when(case_twins(label, new), new_conf >= conf + margin)
        .when((conf < 0.86) | ~is_alnum(label), True)
        .otherwise(same_class & (new_conf >= conf - 0.05))
    )


def _digit_beats_letter(digit: Column, digit_conf: Column, label: Column, conf: Column) -> Column:
    hit = F.lit(False)
    for d, letter, at_least, below in DIGIT_OVER_LETTER:
        hit = hit | ((digit == d) & (label == letter) & (digit_conf >= at_least) & (conf < below))
    return hit


def _letter_wins(label: Column, conf: Column, letter: Column, letter_conf: Column) -> Column:
    return (
        F.when(~is_alnum(label), letter_conf >= 0.55)
        .when(is_alpha(label), (letter == label) & (letter_conf >= 0.70) & (letter_conf >= conf - 0.03))
        .otherwise((letter_conf >= 0.92) & (letter_conf >= conf + 0.08))
    )


def arbitrate(scores: DataFrame) -> DataFrame:
    """Final label, confidence and alternatives of every region.

    Each step only changes what earlier ones left open: shape punctuation, exemplar
    fallback, alphanumeric recognizer, digit rescue, letter recognizer, shape
    tie-break, and last the confidence of a case pair.
    """

    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    plain = F.col("punctuation").isNull()
    label, conf = F.col("label"), F.col("confidence")
    letter_conf = F.when(F.col("_letter"), F.col("letter_confidence")).otherwise(0.0)
    false = F.lit(False)

    def put(df: DataFrame, flag: str, condition: Column, new: Column, new_conf: Column) -> DataFrame:
        return (
            df.withColumn(flag, F.coalesce(condition, false))
            .withColumn("confidence", F.when(F.col(flag), F.greatest(conf, new_conf)).otherwise(conf))
            .withColumn("label", F.when(F.col(flag), new).otherwise(label))
        )

    out = put(scores, "_punct", ~plain, F.col("punctuation"), F.lit(SHAPE_CONFIDENCE))
    out = apply_fallback(
        out.withColumn("exemplar_label", F.when(plain, F.col("exemplar_label")))
    )
    out = out.withColumn(
        "_letter",
        plain & F.col("letter_label").isNotNull() & wants_letter_score(width, height, label, conf),
    )
    out = put(
        out, "_alnum",
        plain & F.col("alnum_label").isNotNull()
        & _alnum_wins(label, conf, F.col("alnum_label"), F.col("alnum_confidence"), letter_conf),
        F.col("alnum_label"), F.col("alnum_confidence"),
    )
    beats = F.col("_beats")
    out = out.withColumn(
        "_beats",
        F.coalesce(_digit_beats_letter(F.col("digit_label"), F.col("digit_confidence"), label, conf), false),
    )
    out = put(
        out, "_digit",
        plain & F.col("digit_label").isNotNull() & wants_digit_score(width, height, label, conf)
        & (F.col("digit_confidence") >= 0.80)
        & ((letter_conf < 0.9) | beats)
        & (beats | ~is_alpha(label) | (conf < 0.82)),
        F.col("digit_label"), F.col("digit_confidence"),
    )
    out = put(
        out, "_used_letter",
        F.col("_letter") & ~F.col("_digit") & _letter_wins(label, conf, F.col("letter_label"), letter_conf),
        F.col("letter_label"), letter_conf,
    )
    shape = (
        F.when(F.col("like_four") & label.isin(*FOUR_CANDIDATES), "4")
        .when(F.col("like_seven") & label.isin(*SEVEN_CANDIDATES), "7")
        .when(F.col("like_one") & label.isin(*ONE_CANDIDATES), "1")
    )
    out = out.withColumn("_shape", F.when(plain, shape))
    out = put(out, "_shaped", F.col("_shape").isNotNull(), F.col("_shape"), F.lit(SHAPE_CONFIDENCE))
    guesses = F.when(plain & F.col("alnum_label").isNotNull(), guesses_or_empty(F.col("alnum_alternatives")))
    out = out.withColumn("_guesses", F.coalesce(guesses, empty_guesses())).withColumn(
        "_case", F.get(F.filter(case_pair(F.col("_guesses")), lambda g: g["label"] == F.col("label")), F.lit(0))
    )
    return out.withColumn("confidence", F.coalesce(F.col("_case.confidence"), conf)).select(
        *[c for c in scores.columns if c not in SCORE_COLUMNS],
        "label", "confidence",
        F.when(F.size("_guesses") > 0, compact_guesses(F.col("_guesses"), label))
        .otherwise(empty_guesses())
        .alias("alternatives"),
    )
