"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.llm.common import row_keyed, ship_package
from glyphloom.session import cut_lineage

BLOCK_ROWS = 16_384
"""Rows of an index block, about: a block of 64 ten-bit attributes takes 1.3 MB of slices and 8 MB of attributes."""
TILE_QUERIES = 512
"""Queries that meet a block in one task, about."""
LARGEST_SCORE = 1 << 63
"""Inner products must stay below this in size, for scores are longs."""


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs."""

    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components. An empty vector scores 0 with all others."""

    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def build_index(rows: DataFrame, low: int, bits: int, width: int, blocks: int) -> DataFrame:
    """One row per block: row keys, identifiers and the attributes' bit slices.

    Slice (a, b) is a bitmap over the block's rows with bit b of attribute a, counted from
    ``low``. Rows stand in the order of identifiers, so the first set bits are the least ones.
    """

    ship_package(rows.sparkSession)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["no_id", "id", "row_key"])
        values = np.zeros((len(part), width), np.int64)
        for at, v in enumerate(part["v"]):
            values[at, : len(v)] = v
        return pd.DataFrame([(part["block"].iloc[0], part["row_key"].tolist(), slices_of(values - low, bits).tobytes(), values.astype("<i8").tobytes())], columns=["block", "row_keys", "slices", "attributes"])

    return (
        rows.select((F.pmod(F.xxhash64("row_key"), F.lit(blocks))).cast("int").alias("block"), "row_key", F.col("id").isNull().alias("no_id"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), "v")
        .groupBy("block").applyInPandas(build, "block int, row_keys array<bigint>, slices binary, attributes binary")
    )


def slices_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps [attribute, bit, word] of non-negative values [row, attribute]."""

    n, width = values.shape
    words = -(-n // 64)
    out = np.zeros((width, bits, words * 8), np.uint8)
    for b in range(bits):
        out[:, b, : -(-n // 8)] = np.packbits(((values >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
    return out.view("<u8")


def sum_slices(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices, least first, of sum(|w| * u) over attributes; u is complemented where w < 0.

    Every set bit j of a weight adds the attribute's slices j places up. Bitmaps of one place
    are reduced three to two by full adders, all triples at once, until one is left.
    """

    bits = slices.shape[1]
    size = np.abs(weights)
    flip = np.where(weights < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    places: dict[int, list[np.ndarray]] = {}
    for j in range(int(size.max()).bit_length()):
        chosen = np.flatnonzero((size >> j) & 1)
        if len(chosen):
            picked = slices[chosen] ^ flip[chosen, None, None]
            for b in range(bits):
                places.setdefault(j + b, []).append(picked[:, b])
    out, place = [], 0
    while places:
        stack = places.pop(place, [])
        x = np.concatenate(stack) if stack else np.zeros((1, slices.shape[2]), np.uint64)
        while len(x) > 1:
            t = len(x) // 3
            if t:
                a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                half = a ^ b
                carry, x = (a & b) | (half & c), np.concatenate([half ^ c, x[3 * t :]])
            else:
                carry, x = x[:1] & x[1:], x[:1] ^ x[1:]
            places.setdefault(place + 1, []).append(carry)
        out.append(x[0])
        place += 1
    return out


def largest_rows(slices: list[np.ndarray], n: int, k: int) -> np.ndarray:
    """Positions of the ``k`` largest sums: certain rows from the top slice down, then boundary rows in order."""

    every = np.zeros(len(slices[0]) * 8 if slices else -(-n // 64) * 8, np.uint8)
    ones = np.packbits(np.ones(n, np.uint8), bitorder="little")
    every[: len(ones)] = ones
    tied = every.view("<u8")
    certain = np.zeros_like(tied)
    for s in reversed(slices):
        more = certain | (tied & s)
        count = int(np.bitwise_count(more).sum())
        if count > k:
            tied = tied & s
        else:
            certain, tied = more, tied & ~s
            if count == k:
                break
    rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    sure = rows(certain)
    return np.concatenate([sure, rows(tied)[: k - len(sure)]])


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` largest inner products of each query row.

    Queries are rows whose key is a multiple of ``query_every``; every other usable row is a
    candidate. Ties go to the smaller key, null keys last. Repeated rows are rows of their
    own. Shorter vectors count as padded with zeros. Without usable rows the result is empty.
    """

    rows = row_keyed(vectors.filter(usable(F.col(vector))).select(F.col(key).alias("id"), quantised(F.col(vector), scale).alias("v")))
    shape = rows.agg(F.count("*"), F.min(F.array_min("v")), F.max(F.array_max("v")), F.max(F.size("v"))).first()
    n, low, high, width = shape[0] or 0, min(shape[1] or 0, 0), max(shape[2] or 0, 0), max(shape[3] or 0, 1)
    if max(-low, high) ** 2 * width >= LARGEST_SCORE:
        raise ValueError(f"attributes from {low} to {high}: their inner products may not fit a long")
    bits = max(1, (high - low).bit_length())
    is_query = F.col("id") % query_every == 0
    n_queries = rows.filter(is_query).count()
    blocks, tiles = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // TILE_QUERIES))
    index = cut_lineage(build_index(rows, low, bits, width, blocks))
    asked = rows.filter(is_query).select(
        F.pmod(F.xxhash64("row_key", F.lit(1)), F.lit(tiles)).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("row_key").alias("query"), "v",
    )
    placed = index.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(queries):
            keys = np.asarray(block["row_keys"].iloc[0])
            slices = np.frombuffer(block["slices"].iloc[0], "<u8").reshape(width, bits, -1)
            attributes = np.frombuffer(block["attributes"].iloc[0], "<i8").reshape(-1, width)
            for query, v in zip(queries["query"], queries["v"]):
                weights = np.zeros(width, np.int64)
                weights[: len(v)] = v
                best = largest_rows(sum_slices(slices, weights), len(keys), k + 1)
                scores = attributes[best] @ weights
                out += [(query, r, s) for r, s in zip(keys[best].tolist(), scores.tolist()) if r != query]
        return pd.DataFrame(out, columns=["query", "row_key", "score"]).astype("int64")

    found = asked.groupBy("block", "tile").cogroup(placed.groupBy("block", "tile")).applyInPandas(lambda q, b: search(b, q), "query bigint, row_key bigint, score bigint")
    names = rows.select("row_key", "id")
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row_key")
    return (
        found.join(names, "row_key").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .join(names.select(F.col("row_key").alias("query"), F.col("id").alias("query_id")), "query")
        .select("query_id", "rank", F.col("id").alias(key), "score")
    )


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.r, b.vec_id, b.r AS other, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
