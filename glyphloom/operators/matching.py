"""Nearest-exemplar match and its use as a fallback label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.session import cut_lineage

# --- fixed values: when and how far the fallback is trusted -------------------------
FALLBACK_BELOW = 0.82
DISTANCE_SCALE = 32.0
FALLBACK_RANGE = (0.35, 0.9)

# Numbers of one bank block, which a task holds with a chunk of queries (32 MB of doubles).
MAX_BLOCK_VALUES = 4_000_000
# Vectors that blocks are measured from; the driver sends them with the code.
PIVOTS = 64
# Queries of a block that one task takes, about.
CHUNK_QUERIES = 4_000
# Numbers of one intermediate distance table inside a task (32 MB of doubles).
_TABLE_VALUES = 4_000_000


def _nearest(queries: np.ndarray, bank: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of the closest bank vector and its exact distance; the earlier row wins a tie.

    The matrix product finds the few rows that could be closest, and only those
    are measured exactly.
    """

    best_row = np.zeros(len(queries), dtype=np.int64)
    best_distance = np.zeros(len(queries))
    step = max(1, _TABLE_VALUES // len(bank))
    for start in range(0, len(queries), step):
        block = queries[start : start + step]
        scale = (block**2).sum(axis=1)[:, None] + squares[None, :]
        rough = scale - 2.0 * (block @ bank.T)
        slack = 1e-9 * (scale.max(axis=1, keepdims=True) + 1.0)
        row, col = np.nonzero(rough <= rough.min(axis=1, keepdims=True) + slack)
        exact = np.sqrt(((block[row] - bank[col]) ** 2).sum(axis=1))
        order = np.lexsort((col, exact, row))
        _, first = np.unique(row[order], return_index=True)
        chosen = order[first]
        best_row[start : start + step] = col[chosen]
        best_distance[start : start + step] = exact[chosen]
    return best_row, best_distance


def nearest_exemplar(
    queries: DataFrame,
    bank: DataFrame,
    keep: list[str],
    vector: str = "vec",
    exemplar_id: str = "sample_id",
    exemplar_label: str = "label",
) -> DataFrame:
    """The closest exemplar of every query, the least id on ties: ``keep`` + (exemplar_id, exemplar_label, distance).

    A metric join, exact for a bank of any size. Each exemplar belongs to its nearest of a few
    pivots (at most PIVOTS, the only vectors that the driver sees), and a pivot's exemplars are
    dealt into blocks of MAX_BLOCK_VALUES numbers. Queries meet the blocks of their own nearest
    pivot first. The distance found there rules out every other block whose members, by the
    triangle inequality, are all farther away; the rest are met too. Queries of a block are dealt
    into chunks, each with a copy of the block, so no task gets more than a chunk and a block.
    An empty bank gives nulls.
    """

    stored = cut_lineage(
        bank.select(
            F.col(exemplar_id).cast("long").alias("i"), F.col(exemplar_label).alias("l"), F.col(vector).cast("array<double>").alias("v")
        )
    )
    asked = cut_lineage(
        queries.select(*keep, F.col(vector).cast("array<double>").alias("_v"), F.monotonically_increasing_id().alias("_q"))
    )
    size = stored.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    block_rows = max(1, MAX_BLOCK_VALUES // (size["d"] or 1))
    wanted = min(PIVOTS, -(-size["n"] // block_rows))
    chosen = [row["v"] for row in stored.orderBy(F.xxhash64("i"), "i").limit(wanted).select("v").collect()] if wanted else []
    answer = T.StructType([*T.StructType.fromDDL("q long, distance double, i long").fields, T.StructField("l", stored.schema["l"].dataType)])
    if not chosen:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("exemplar_id", "long"), ("exemplar_label", dict(stored.dtypes)["l"]), ("distance", "double"))]
        return asked.select(*keep, *nothing)
    pivots = np.array(chosen, np.float64)
    placed = _with_pivot(stored, "v", pivots)
    parts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    members = cut_lineage(placed.join(parts, "pivot").withColumn("block", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int")).drop("parts"))
    # One row for each block: how near and how far its members are from their pivot.
    rings = [tuple(r) for r in members.groupBy("pivot", "block").agg(F.min("r"), F.max("r")).collect()]
    chunks = max(1, -(-asked.count() // CHUNK_QUERIES))
    near = _with_pivot(asked.select("_q", "_v"), "_v", pivots)
    blocks = F.array(*[F.struct(F.lit(p).alias("pivot"), F.lit(b).alias("block")) for p, b, _, _ in rings])
    own = near.withColumn("_b", F.explode(F.filter(blocks, lambda b: b["pivot"] == F.col("pivot")))).select("_q", "_v", "_b.pivot", "_b.block")
    first = cut_lineage(_met(own, members, chunks, answer).groupBy("q").agg(F.min(F.struct("distance", "i", "l")).alias("m")))
    others = _blocks_in_reach(near.join(first.select(F.col("q").alias("_q"), F.col("m.distance").alias("d")), "_q"), pivots, rings)
    second = _met(others, members, chunks, answer).groupBy("q").agg(F.min(F.struct("distance", "i", "l")).alias("m"))
    best = first.unionByName(second).groupBy("q").agg(F.min("m").alias("m"))
    return asked.join(best.withColumnRenamed("q", "_q"), "_q", "left").select(
        *keep, F.col("m.i").alias("exemplar_id"), F.col("m.l").alias("exemplar_label"), F.col("m.distance").alias("distance")
    )


def _with_pivot(df: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """``df`` with the number of the nearest pivot and its distance ``r``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squares = (pivots**2).sum(axis=1)
        for batch in batches:
            if not batch.empty:
                row, distance = _nearest(np.stack(batch[vector].to_numpy()).astype(np.float64), pivots, squares)
                yield batch.assign(pivot=row.astype(np.int32), r=distance)

    return df.mapInPandas(run, T.StructType([*df.schema, *T.StructType.fromDDL("pivot int, r double")]))


def _blocks_in_reach(near: DataFrame, pivots: np.ndarray, rings: list[tuple[int, int, float, float]]) -> DataFrame:
    """(_q, _v, pivot, block) for blocks of other pivots that may hold something as near as ``d``.

    A member at distance r from a pivot is at least abs(distance to the pivot - r) away.
    """

    numbers = np.array([(p, b) for p, b, _, _ in rings], np.int32)
    inner, outer = np.array([r[2] for r in rings]), np.array([r[3] for r in rings])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            vectors = np.stack(batch["_v"].to_numpy()).astype(np.float64)
            best = batch["d"].to_numpy()
            for start in range(0, len(batch), 1024):
                part = vectors[start : start + 1024]
                away = np.stack([np.sqrt(((part - p) ** 2).sum(axis=1)) for p in pivots], axis=1)[:, numbers[:, 0]]
                least = np.maximum(away - outer, inner - away)
                slack = 1e-9 * (1.0 + away + outer)
                own = batch["pivot"].to_numpy()[start : start + 1024, None] == numbers[None, :, 0]
                row, ring = np.nonzero((least <= best[start : start + 1024, None] + slack) & ~own)
                yield pd.DataFrame(
                    {"_q": batch["_q"].to_numpy()[start + row], "_v": pd.Series(list(part[row]), dtype=object), "pivot": numbers[ring, 0], "block": numbers[ring, 1]}
                )

    return near.mapInPandas(run, "_q long, _v array<double>, pivot int, block int")


def _met(pairs: DataFrame, members: DataFrame, chunks: int, answer: T.StructType) -> DataFrame:
    """(q, distance, i, l): for each pair of a query and a block the nearest member."""

    def run(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or block.empty:
            return pd.DataFrame({"q": np.zeros(0, "int64"), "distance": np.zeros(0), "i": np.zeros(0, "int64"), "l": pd.Series([], dtype=object)})
        block = block.sort_values("i", kind="stable")
        vectors = np.stack(block["v"].to_numpy()).astype(np.float64)
        row, distance = _nearest(np.stack(asked["_v"].to_numpy()).astype(np.float64), vectors, (vectors**2).sum(axis=1))
        return pd.DataFrame({"q": asked["_q"].to_numpy(), "distance": distance, "i": block["i"].to_numpy()[row], "l": block["l"].to_numpy()[row]})

    dealt = pairs.withColumn("chunk", F.pmod(F.xxhash64("_q"), F.lit(chunks)).cast("int"))
    copies = members.select("pivot", "block", "i", "l", "v", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    keys = ["pivot", "block", "chunk"]
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(run, answer)


def fallback_confidence(distance: Column) -> Column:
    low, high = FALLBACK_RANGE
    return F.greatest(F.lit(low), F.least(F.lit(high), 1.0 - distance / DISTANCE_SCALE))


def apply_fallback(matched: DataFrame, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """Take the exemplar's label where the recognizer was below 0.82."""

    unsure = (F.col(confidence) < FALLBACK_BELOW) & F.col("exemplar_label").isNotNull()
    return (
        matched.withColumn("_unsure", unsure)
        .withColumn(label, F.when(F.col("_unsure"), F.col("exemplar_label")).otherwise(F.col(label)))
        .withColumn(
            confidence,
            F.when(F.col("_unsure"), fallback_confidence(F.col("distance"))).otherwise(F.col(confidence)),
        )
        .drop("_unsure")
    )
