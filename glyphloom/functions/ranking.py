"""Seeded orders and per-group ranks that stay balanced when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.session import cut_lineage


def seeded_hash(seed: int, *columns: Column) -> Column:
    """A reproducible random order: ``md5(seed|id)``."""

    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group.

    Each group is spread over ``salts`` sub-groups, cut there, then cut once more,
    so one group never meets in one task before it is down to ``salts`` times ``n``.
    """

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    df = salted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n).drop("_rank", "_salt")
    whole = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n).drop("_rank")


def _bucket_offsets(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and hash bucket: rows in the bucket, rows before it, rows in the group."""

    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_in_bucket"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0))).withColumn(
        "_group_rows", F.sum("_in_bucket").over(W.partitionBy(*keys))
    )


def _with_bucket(df: DataFrame, hash_column: Column, digits: int) -> DataFrame:
    return df.withColumn("_hash", hash_column).withColumn("_bucket", F.substring("_hash", 1, digits))


def hashed_rank(
    df: DataFrame, keys: list[str], hash_column: Column, tie: str, name: str = "rank", digits: int = 3
) -> DataFrame:
    """Exact row number per group in hash order, without one task per group.

    The leading hash digits cut each group into equal buckets. Their sizes are
    counted with partial aggregation and summed to give each bucket its offset,
    so only single buckets are sorted, however large a group is.
    """

    hashed = _with_bucket(df, hash_column, digits)
    joined = hashed.join(_bucket_offsets(hashed, keys), [*keys, "_bucket"])
    inside = W.partitionBy(*keys, "_bucket").orderBy("_hash", tie)
    return (
        joined.withColumn(name, F.col("_before") + F.row_number().over(inside))
        .withColumnRenamed("_group_rows", "group_rows")
        .drop("_hash", "_bucket", "_in_bucket", "_before")
    )


def _at_cuts(df: DataFrame, keys: list[str], hash_column: Column, take: Column, digits: int) -> DataFrame:
    """Rows with the bucket their group is cut in (``_cut``) and what is left to take there.

    The cuts are one row per group. They are written first, so that the join plans
    with their real size: a broadcast as long as they are small, a shuffle beyond.
    """

    hashed = _with_bucket(df, hash_column, digits)
    offsets = _bucket_offsets(hashed, keys).withColumn("_take", take)
    at = offsets.filter((F.col("_before") < F.col("_take")) & (F.col("_take") <= F.col("_before") + F.col("_in_bucket")))
    cuts = cut_lineage(at.select(*keys, F.col("_bucket").alias("_cut"), (F.col("_take") - F.col("_before")).alias("_left")))
    return hashed.join(cuts, keys, "left")


def _taken_at_cut(rows: DataFrame, keys: list[str], tie: str) -> DataFrame:
    inside = W.partitionBy(*keys).orderBy("_hash", tie)
    cut = rows.filter(F.col("_bucket") == F.col("_cut"))
    return cut.withColumn("is_head", F.row_number().over(inside) <= F.col("_left"))


_HELPERS = ["_hash", "_bucket", "_cut", "_left"]


def hashed_head(
    df: DataFrame, keys: list[str], hash_column: Column, tie: str, take: Column, digits: int = 3
) -> DataFrame:
    """Flag ``is_head`` for the first ``take`` rows of each group in hash order.

    ``take`` may use ``_group_rows``. Only the one bucket a group's cut falls into
    is shuffled and sorted; every other row is decided where it is read.
    """

    rows = _at_cuts(df, keys, hash_column, take, digits)
    elsewhere = rows.filter(~F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False)))
    decided = elsewhere.withColumn("is_head", F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)))
    return decided.unionByName(_taken_at_cut(rows, keys, tie)).drop(*_HELPERS)


def hashed_top(
    df: DataFrame, keys: list[str], hash_column: Column, tie: str, n: int, digits: int = 3
) -> DataFrame:
    """The first ``n`` rows of each group in hash order; smaller groups stay whole.

    Rows beyond a group's cut are dropped where they are read.
    """

    rows = _at_cuts(df, keys, hash_column, F.least(F.lit(n), F.col("_group_rows")), digits)
    before = rows.filter(F.col("_bucket") < F.col("_cut"))
    at_cut = _taken_at_cut(rows, keys, tie).filter("is_head").drop("is_head")
    return before.unionByName(at_cut).drop(*_HELPERS)


def hash_number(hash_column: Column, digits: int = 15) -> Column:
    """The leading hex digits of a hash as a number."""

    return F.conv(F.substring(hash_column, 1, digits), 16, 10).cast("long")
