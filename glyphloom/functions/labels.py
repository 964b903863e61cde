"""Label vocabularies, lookalike groups and label predicates as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: vocabularies -------------------------------------------------
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
FOLDED_LABELS = list(DIGITS + UPPER)
MIXED_LABELS = list(DIGITS + UPPER + LOWER)
# 93 printable characters: code 33 to 126 without the backslash.
CHARACTER_LABELS = [chr(code) for code in range(33, 127) if code != 92]

# --- fixed values: visual lookalike groups --------------------------------------
CHARACTER_GROUPS = [
    "0Oo", "1Ili|!/", "5Ss", "2Zz", "8B", "Cc", "Xx", "Vv", "Kk", "Pp", "Tt7", "-_",
    ".'`", ":;i!", "+t", "&def", "@e", "9qg", "Yy4", "Uuv", "NnMm", "Jj",
]
MIXED_GROUPS = [
    "0Oo", "1Ili|!/", "5Ss", "2Zz", "8B", "Cc", "Xx", "Vv", "Kk", "Pp", "Tt7",
    "9qg", "Yy4", "Uuv", "NnMm", "Jj",
]
DISPLAY_GROUPS = [
    "0Oo", "1Ili|!/", "5Ss", "2Zz", "8B", "Cc", "Xx", "Vv", "Kk", "Pp", "Tt7", "-_",
    ".'`", ":;i!", "+t", "9qg", "Yy4", "Uuv", "NnMm", "Jj",
]

# --- fixed values: labels to collect first, and how many of each ----------------
PRIORITY_LABELS = "sOV1cIFom0lUkiugqMCPSvzxp2Z9f5WwYy4Tt7JjKX-_.'|/:;!+"
TARGET_PER_LABEL = 20


def vocabulary(spark: SparkSession, labels: list[str], vocab_id: str = "vocab") -> DataFrame:
    """``(vocab_id, idx, label)``; a label's position is its target index."""

    rows = [(vocab_id, index, label) for index, label in enumerate(labels)]
    return spark.createDataFrame(rows, "vocab_id string, idx int, label string")


def group_table(spark: SparkSession, groups: list[str], group_set: str = "groups") -> DataFrame:
    """``(group_set, group_id, label)``; one label may sit in several groups."""

    rows = [(group_set, gid, label) for gid, members in enumerate(groups) for label in members]
    return spark.createDataFrame(rows, "group_set string, group_id int, label string")


def is_digit(label: Column) -> Column:
    return label.rlike(r"^\p{Nd}+$")


def is_alpha(label: Column) -> Column:
    return label.rlike(r"^\p{L}+$")


def is_alnum(label: Column) -> Column:
    return label.rlike(r"^[\p{L}\p{N}]+$")


def is_upper(label: Column) -> Column:
    return label.rlike(r"\p{Lu}") & (F.upper(label) == label)


def is_lower(label: Column) -> Column:
    return label.rlike(r"\p{Ll}") & (F.lower(label) == label)


def character_group(label: Column) -> Column:
    """digits / letters / punctuation."""

    return F.when(is_digit(label), "digits").when(is_alpha(label), "letters").otherwise("punctuation")


def case_group(label: Column) -> Column:
    """digit / upper / lower; whatever is neither digit nor upper counts as lower."""

    return F.when(is_digit(label), "digit").when(is_upper(label), "upper").otherwise("lower")


def type_index(target: Column) -> Column:
    """Position in the 62-label order to 0 digit, 1 upper, 2 lower."""

    return F.when(target >= 36, 2).when(target >= 10, 1).otherwise(0)


def fold_target(target: Column) -> Column:
    """62-label target to the 36-label one: lower case lands on its upper case."""

    return F.when(target >= 36, target - 26).otherwise(target)


def same_letter(first: Column, second: Column) -> Column:
    """One letter each, equal but for case. The cheap tests come first."""

    return (
        (F.lower(first) == F.lower(second))
        & (F.length(first) == 1)
        & (F.length(second) == 1)
        & is_alpha(first)
        & is_alpha(second)
    )


def case_twins(first: Column, second: Column) -> Column:
    return (first != second) & same_letter(first, second)


def share_group(first: Column, second: Column, groups: list[str]) -> Column:
    """True when some group holds both labels (the relation is not transitive)."""

    tests = [F.lit(g).contains(first) & F.lit(g).contains(second) for g in groups]
    both_single = (F.length(first) == 1) & (F.length(second) == 1)
    return both_single & reduce(lambda a, b: a | b, tests)


def matches_ambiguous(expected: Column, predicted: Column, groups: list[str] = CHARACTER_GROUPS) -> Column:
    """Exact, or the same letter in the other case, or a lookalike."""

    return (expected == predicted) | same_letter(expected, predicted) | share_group(expected, predicted, groups)


def matches_visual(expected: Column, predicted: Column, groups: list[str] = MIXED_GROUPS) -> Column:
    """Exact or lookalike; the other case of the same letter never counts."""

    return (expected == predicted) | (
        ~same_letter(expected, predicted) & share_group(expected, predicted, groups)
    )


def matches_casefold(expected: Column, predicted: Column) -> Column:
    return (expected == predicted) | (
        is_alpha(expected) & is_alpha(predicted) & (F.lower(expected) == F.lower(predicted))
    )


def characters(text: Column) -> Column:
    """The characters of a string as an array; an empty string gives an empty array."""

    return F.filter(F.split(text, ""), lambda c: c != "")


def sequence_matches(target: Column, prediction: Column) -> Column:
    """Equal strings, or equal lengths with every position an ambiguous match."""

    pairs = F.zip_with(
        characters(target), characters(prediction), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    return (target == prediction) | (
        (F.length(target) == F.length(prediction))
        & F.forall(pairs, lambda p: matches_ambiguous(p["a"], p["b"]))
    )


def distinct_characters(text: Column, allowed: Column | None = None) -> Column:
    """Characters in first-seen order without repeats, optionally only the allowed ones."""

    chars = F.array_distinct(characters(text))
    if allowed is None:
        return chars
    return F.filter(chars, lambda c: F.array_contains(allowed, c))


def numeric_entity(label: Column) -> Column:
    """Code point of a one-character label, used as a folder name."""

    return F.ascii(label)
