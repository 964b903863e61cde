"""Best-fit packing of token sequences by bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens. A sequence that still has room is a
gap. In a round, pieces and gaps are range-sorted together by size, largest first, and swept:
a piece takes the smallest gap at least its size that no earlier piece took. The sweep is
local to each range; what a range leaves over (pieces without a gap, gaps without a piece)
is matched across ranges by rank, from one pair of counts per range. Gaps shrink by what
they took, and the next round starts. When a round places nothing, as many sequences are
opened as the rest fills at least.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.llm.common import arrow_rows, row_keyed
from glyphloom.session import cut_lineage

CAPACITY = 2048
CACHE_ENTRIES = 400_000
RANGE_ROWS = 500_000
"""Pieces and gaps of a sorted range, about."""

WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
"""White space, and what Python takes for it."""
NOT_WHITE = WHITE.replace("[", "[^", 1)

Encode = Callable[[pa.Array], pa.Array]
"""Token ids of each text, as lists of unsigned 32-bit numbers."""


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit bytes.

    Byte-level BPE never joins a space to the word before it. A text is therefore cut before
    each space that follows a character that is no white space, and every chunk is encoded
    alone, once a call however often it comes. All chunks but a text's first begin with that space.
    """

    def __init__(self, encode: Encode) -> None:
        self.encode, self.cut = encode, re.compile(r"(?<=\S) ").split

    def __call__(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        runs = pc.match_substring_regex(column, WHITE + " ")
        plain = iter(self._ids(pc.split_pattern(column.filter(pc.invert(runs)), " ")))
        odd = iter(self._ids(pa.array([self.cut(t) for t in column.filter(runs).to_pylist()], pa.list_(pa.large_string()))))
        return [next(odd) if r else next(plain) for r in runs.to_pylist()]

    def _ids(self, cut: pa.ListArray) -> list[bytes]:
        """Ids of texts, each given as its chunks without the spaces between them."""

        if not len(cut):
            return []
        coded, ends = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        words, at, heads = coded.dictionary, coded.indices.to_numpy().copy(), cut.flatten().take(pa.array(ends[:-1]))
        at[ends[:-1]] = np.arange(len(words), len(words) + len(heads))
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), words, pa.scalar("", pa.large_string()))
        taken = self.encode(pa.concat_arrays([spaced, heads])).take(pa.array(at))
        data, stops = taken.flatten().to_numpy().tobytes(), (4 * taken.offsets.to_numpy()[ends]).tolist()
        return [data[low:high] for low, high in zip(stops, stops[1:])]


_ENCODERS: dict[str, ChunkEncoder] = {}
BEYOND_LATIN = r"[^\x00-\x{24F}]"
"""Chunks without these characters go to the ranked encoder; on them both libraries' patterns agree."""
IDS = pa.large_list(pa.uint32())


def _by_kind(chunks: pa.Array, kind: pa.Array, yes: Encode, no: Encode) -> pa.Array:
    """Ids of ``chunks`` by ``yes`` where ``kind`` holds and by ``no`` elsewhere, in their order."""

    order = pc.sort_indices(kind)
    found = pa.concat_arrays([no(chunks.filter(pc.invert(kind))), yes(chunks.filter(kind))])
    return found.take(pc.sort_indices(order))


def file_encoder(path: str) -> ChunkEncoder:
    """The encoder of a byte-level BPE file of ``tokenizers``; a worker loads it once.

    Special tokens in a text are ordinary text. Where the file's merges are ranked by their
    ids, Latin chunks go through tiktoken with ranks made from the same file, which gives
    the same ids several times faster; all other chunks go through ``tokenizers``.
    """

    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        ranked, known = _ranked(path), {}

        def listed(chunks: pa.Array) -> pa.Array:
            texts = chunks.to_pylist()
            new = list(dict.fromkeys(t for t in texts if t not in known))
            if len(known) + len(new) > CACHE_ENTRIES:
                known.clear()
                new = list(dict.fromkeys(texts))
            known.update(zip(new, (e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False))))
            return pa.array([known[t] for t in texts], IDS)

        def encode(chunks: pa.Array) -> pa.Array:
            return listed(chunks) if ranked is None else _by_kind(chunks, pc.match_substring_regex(chunks, BEYOND_LATIN), listed, ranked)

        _ENCODERS[path] = ChunkEncoder(encode)
    return _ENCODERS[path]


def _ranked(path: str) -> Encode | None:
    """tiktoken over the file's own vocabulary, or None if its merges aren't numbered in order after the bytes.

    Chunks that begin with a space and end in no white space are encoded as one text, since a token ends
    where each of them does; the widths of the tokens say which are whose. All others are encoded alone.
    """

    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    alphabet = ByteLevel.alphabet()
    shown = {chr(b) if chr(b) in alphabet and b != 32 else None: b for b in range(256)}
    shown.pop(None)
    spare = (b for b in range(256) if b not in shown.values())
    shown |= {c: next(spare) for c in sorted(c for c in alphabet if ord(c) > 255)}
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)) or any(vocab.get(c, 256) > 255 for c in shown):
        return None
    ranks = {bytes(shown[c] for c in token): vocab[token] for token in [*shown, *(a + b for a, b in pairs)]}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    widths[list(ranks.values())] = [len(token) for token in ranks]
    ids_of = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def joined(chunks: pa.Array) -> pa.Array:
        ids = np.array(ids_of("".join(chunks.to_numpy(zero_copy_only=False))), np.uint32)
        stops = np.searchsorted(np.cumsum(widths[ids]), np.cumsum(pc.binary_length(chunks).to_numpy())) + 1
        return pa.LargeListArray.from_arrays(np.concatenate([[0], stops]), ids)

    def alone(chunks: pa.Array) -> pa.Array:
        return pa.array([ids_of(c) for c in chunks.to_pylist()], IDS)

    def encode(chunks: pa.Array) -> pa.Array:
        return _by_kind(chunks, pc.match_substring_regex(chunks, f"^ (?s:.*){NOT_WHITE}\\z"), joined, alone)

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_key, piece, start, length, ids_crc32) of every document, cut where it is longer than ``capacity``.

    The first piece of a cut document holds what is left over, so all others are full.
    ``row_key`` tells rows with equal or null keys apart. Null text is empty: one end token.
    """

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        end, wide = end_id.to_bytes(4, "little"), 4 * capacity
        for part in slices:
            out = []
            for (doc_id, row_key, _), ids in zip(part, file_encoder(tokenizer)([p[2] or "" for p in part])):
                ids += end
                n = len(ids)
                first = n % wide or wide
                for k, stop in enumerate(range(first, n + 1, wide)):
                    start = max(0, stop - wide)
                    out.append((doc_id, row_key, k, start // 4, (stop - start) // 4, zlib.crc32(ids[start:stop])))
            yield out

    keyed = docs.select(key, F.monotonically_increasing_id().alias("row_key"), text)
    kind = dict(docs.dtypes)[key]
    return arrow_rows(keyed, [key, "row_key", text], f"`{key}` {kind}, row_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint", rows)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items(length, ...)`` with ``sequence_id`` and ``offset``: best fit, gapless from 0.

    Lengths lie between 1 and ``capacity``. Items over half of it share a sequence with no
    equal and open their own at once. State between rounds is two tables of numbers (open
    items, gaps) in the shared folder; the driver sees counts per sorted range only.
    """

    spark = items.sparkSession
    keyed = row_keyed(items, "item")
    sizes = keyed.select("item", F.col("length").cast("long").alias("size"))
    half = capacity // 2
    placed = [sizes.filter(F.col("size") > half).select("item", F.col("item").alias("sequence_id"), F.lit(-1).alias("turn"), F.lit(0).alias("slot"))]
    gaps = sizes.filter((F.col("size") > half) & (F.col("size") < capacity)).select(F.col("item").alias("sequence_id"), (capacity - F.col("size")).alias("room"))
    rest = sizes.filter(F.col("size") <= half)
    turn = opened = 0  # sequences that no large item opened get negative numbers
    while True:
        left = rest.agg(F.count("*"), F.sum("size"), F.max("size"), F.min("size")).first()
        if not left[0]:
            break
        matched = cut_lineage(_round(rest, gaps.filter(F.col("room") >= left[3]), left[2]))
        took = matched.groupBy("sequence_id").agg(F.sum("size").alias("taken"))
        if not matched.isEmpty():
            placed.append(matched.select("item", "sequence_id", F.lit(turn).alias("turn"), "slot"))
            gaps = cut_lineage(
                gaps.join(took, "sequence_id", "left").select("sequence_id", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room")).filter("room > 0")
            )
            rest = cut_lineage(rest.join(matched.select("item"), "item", "left_anti"))
        else:
            n = -(-left[1] // capacity)
            fresh = spark.range(opened, opened + n).select((-F.col("id") - 1).alias("sequence_id"), F.lit(capacity).cast("long").alias("room"))
            gaps, opened = cut_lineage(gaps.unionByName(fresh)), opened + n
        turn += 1
    every = placed[0]
    for one in placed[1:]:
        every = every.unionByName(one)
    order = W.partitionBy("sequence_id").orderBy("turn", "slot", "item").rowsBetween(W.unboundedPreceding, -1)
    return (
        keyed.join(every, "item")
        .withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
        .drop("item", "turn", "slot")
    )


def _round(rest: DataFrame, gaps: DataFrame, widest: int) -> DataFrame:
    """(item, size, sequence_id, slot): each gap's slots take one item each.

    A gap of k times the widest item is offered as k slots, each of which holds any item;
    others are one slot. So a round fills a wide gap with many items at once.
    """

    slots = (
        gaps.withColumn("slots", F.greatest(F.lit(1), F.floor(F.col("room") / widest)).cast("int"))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        .select(F.floor(F.col("room") / F.col("slots")).alias("size"), F.lit(0).alias("kind"), F.col("sequence_id").alias("id"), "slot")
    )
    both = slots.unionByName(rest.select("size", F.lit(1).alias("kind"), F.col("item").alias("id"), F.lit(0).alias("slot")))
    parts = max(1, -(-both.count() // RANGE_ROWS))
    spread = F.xxhash64("kind", "id", "slot")
    ranged = both.repartitionByRange(parts, F.desc("size"), "kind", spread).sortWithinPartitions(F.desc("size"), "kind", spread)
    swept = cut_lineage(arrow_rows(ranged.withColumn("range", F.spark_partition_id()), ["size", "kind", "id", "slot", "range"], SWEPT, _sweep))
    counts = {r["range"]: (r["pieces"], r["gaps"]) for r in swept.filter("sequence_id is null or item is null").groupBy("range").agg(F.count("item").alias("pieces"), F.count("sequence_id").alias("gaps")).collect()}
    inside = swept.filter("item is not null and sequence_id is not null").select("item", "size", "sequence_id", "slot")
    links = _carried(counts)
    if not links:
        return inside
    # Bounded by two rows per range: which leftover ranks of a range belong to which match numbers.
    table = rest.sparkSession.createDataFrame(links, "kind int, range int, low long, high long, first long")
    numbered = (
        swept.filter("sequence_id is null or item is null")
        .withColumn("kind", F.when(F.col("item").isNull(), 0).otherwise(1))
        .join(F.broadcast(table), ["kind", "range"])
        .filter("rank between low and high")
        .withColumn("match", F.col("first") + F.when(F.col("kind") == 0, F.col("high") - F.col("rank")).otherwise(F.col("rank") - F.col("low")))
    )
    across = numbered.filter("kind = 1").select("match", "item", "size").join(numbered.filter("kind = 0").select("match", "sequence_id", "slot"), "match")
    return inside.unionByName(across.drop("match"))


SWEPT = "item bigint, size bigint, sequence_id bigint, slot int, range int, rank bigint"


def _sweep(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """Successor sweep of one range in falling size: gaps wait on a stack, a piece takes the top one.

    The top is the smallest gap seen so far, all of which hold the piece. Leftover pieces get
    ranks in their order, leftover gaps from the bottom of the stack.
    """

    stack: list[tuple] = []
    lonely, at = 0, 0
    for part in slices:
        out = []
        for size, kind, ident, slot, at in part:
            if kind == 0:
                stack.append((ident, slot))
            elif stack:
                gap, where = stack.pop()
                out.append((ident, size, gap, where, at, None))
            else:
                out.append((ident, size, None, None, at, lonely))
                lonely += 1
        yield out
    for low in range(0, len(stack), 4096):
        yield [(None, None, gap, where, at, low + k) for k, (gap, where) in enumerate(stack[low : low + 4096])]


def _carried(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Match leftover pieces of each range with leftover gaps of earlier ones, the latest first."""

    links, waiting, number = [], [], 0
    for at in sorted(counts):
        n_pieces, n_gaps = counts[at]
        done = 0
        while done < n_pieces and waiting:
            source, height = waiting.pop()
            n = min(height, n_pieces - done)
            links.append((1, at, done, done + n - 1, number))
            links.append((0, source, height - n, height - 1, number))
            number, done = number + n, done + n
            if height > n:
                waiting.append((source, height - n))
        if n_gaps:
            waiting.append((at, n_gaps))
    return links


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` tokens, one row per piece."""

    return pack(pieces(docs, tokenizer, capacity, key=key, text=text), capacity).drop("row_key")
