"""Near-duplicate classes of SimHash fingerprints by a grid join in a space of bit counts.

A fingerprint is cut into 32 segments of two bits; its point has the number of set bits of each
segment. The Manhattan distance of two points is never more than the fingerprints' Hamming
distance, so links are sought among near points and then verified on the fingerprints.

* Equal fingerprints are one node, however many documents have them.
* The segments are dealt into bands, three more than the bits that may differ. Two points within
  that distance are equal in at least three bands, so they meet in the unit-width cell of one of
  the grids over three bands. Nothing is missed.
* A cell's members are compared inside one task; a large cell is dealt into blocks, and each pair
  of blocks is a task's group of its own. A group's answer is links, not pairs: large groups give a
  spanning forest, so rows grow with the members and not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import arrow_rows, ship_package
from glyphloom.operators.components import connected_components
from glyphloom.session import cut_lineage

WORDS, DISTANCE, SEED = 4, 4, 42
SEGMENTS = 32
AGREEING = 3
"""Bands of a grid. With DISTANCE + AGREEING bands, points within DISTANCE agree in so many."""
BLOCK = 4096
"""Members of a cell that one block takes, on average."""
SMALL = 32
"""Groups of so many members are compared many at a time, each pair once; larger ones give a spanning forest."""
CHUNK = 1 << 15
_LOW = 0x5555555555555555


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of all word windows of a text, repeats included, as an unsigned number.

    A-Z are lower-cased, words end at ASCII white space, a text of fewer words is one window. Null
    and wordless texts give zero. Windows are hashed and counted in chunks, so a very long text
    needs little more than its own words.
    """

    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return 0
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(parts) - words + 1)
    last = ends[len(parts) - n :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, print) per row of ``docs``, the fingerprint as a signed long."""

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            yield [(name, (x := fingerprint(value, words)) - ((x >> 63) << 64)) for name, value in part]

    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return arrow_rows(source, ["id", "text"], f"id {dict(docs.dtypes)[key]}, print bigint", rows)


def _point(prints: Column) -> Column:
    """Bit counts of all segments as a long: a segment of k set bits holds k ones at its low end.

    The Manhattan distance of two points is the number of bits in which their longs differ.
    """

    low, high = F.lit(_LOW), F.shiftrightunsigned(prints, 1).bitwiseAND(F.lit(_LOW))
    own = prints.bitwiseAND(low)
    return F.shiftleft(own.bitwiseAND(high), 1).bitwiseOR(own.bitwiseOR(high))


def _points(prints: np.ndarray) -> np.ndarray:
    own, high = prints & np.uint64(_LOW), (prints >> np.uint64(1)) & np.uint64(_LOW)
    return ((own & high) << np.uint64(1)) | own | high


def _grids(distance: int) -> list[int]:
    """The grids' masks over points, as signed longs: each choice of AGREEING of the bands."""

    bands = np.array_split(np.arange(SEGMENTS), distance + AGREEING)
    masks = [sum(3 << (2 * int(s)) for s in band) for band in bands]
    chosen = [sum(c) for c in combinations(masks, AGREEING)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _near(one: np.ndarray, two: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs link: the Manhattan distance of their points first, the fingerprints for what that leaves."""

    one, two = np.broadcast_arrays(one, two)
    near = np.bitwise_count(_points(one) ^ _points(two)) <= distance
    near[near] = np.bitwise_count(one[near] ^ two[near]) <= distance
    return near


def _forest(prints: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest over the members of a group."""

    found, open_, points = [], prints, _points(prints)
    while len(open_) > 1:
        front, front_points, open_, points = open_[:1], points[:1], open_[1:], points[1:]
        while len(front) and len(open_):
            here, here_points, front, front_points = front[:16], front_points[:16], front[16:], front_points[16:]
            near = np.bitwise_count(here_points[:, None] ^ points[None, :]) <= distance
            a, b = np.nonzero(near)
            near[a, b] = np.bitwise_count(here[a] ^ open_[b]) <= distance
            hit = near.any(axis=0)
            if hit.any():
                found.append((here[near[:, hit].argmax(axis=0)], open_[hit]))
                front, front_points = np.concatenate([front, open_[hit]]), np.concatenate([front_points, points[hit]])
                open_, points = open_[~hit], points[~hit]
    return found


def _group_links(group: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups; ``group`` numbers them in ascending order."""

    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    found = []
    for at in np.flatnonzero(sizes > SMALL):
        found += _forest(prints[starts[at] : starts[at] + sizes[at]], distance)
    rest = np.repeat(sizes <= SMALL, sizes)
    group, prints = group[rest], prints[rest]
    for lag in range(1, int(min(SMALL, sizes.max(initial=1)))):
        pair = np.flatnonzero(group[:-lag] == group[lag:])
        if not len(pair):
            break
        pair = pair[_near(prints[pair], prints[pair + lag], distance)]
        found.append((prints[pair], prints[pair + lag]))
    if not found:
        return prints[:0], prints[:0]
    a, b = (np.concatenate(side) for side in zip(*found))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(src, dst) between distinct fingerprints ``print``: enough links to connect all that are within ``distance`` bits."""

    n = F.col("print")
    cells = nodes.select("print", F.posexplode(F.array(*[_point(n).bitwiseAND(F.lit(m)) for m in _grids(distance)])).alias("grid", "cell"))
    large = cells.groupBy("grid", "cell").agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK)
    large = cut_lineage(large.select("grid", "cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    met = cells.join(large, ["grid", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.filter("blocks = 1 OR own <> other").select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print")
    keys = ["grid", "cell", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(columns: list[np.ndarray]) -> pa.RecordBatch:
            change = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
            a, b = _group_links(np.concatenate([[0], np.cumsum(change)]), columns[4].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [np.concatenate(two) for two in zip(kept, columns)] if kept else columns
            change = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
            cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0  # the last group may go on in the next batch
            if cut:
                yield answer([c[:cut] for c in columns])
            kept = [c[cut:] for c in columns]
        if kept:
            yield answer(kept)

    ship_package(nodes.sparkSession)
    sorted_groups = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_groups.mapInArrow(run, "src bigint, dst bigint").distinct()


def near_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(key, fingerprint, component_id) per row of ``docs``; fingerprints link at ``distance`` or fewer differing bits.

    ``component_id`` is the least key that links reach, its own included. Null, empty and wordless
    texts have the fingerprint zero, which links like any other. Rows that repeat a key are rows of
    their own; a null key is never the least, and a class of null keys alone has a null id. Other
    columns aren't read.
    """

    each = cut_lineage(fingerprints(docs, key, text, words))
    nodes = cut_lineage(each.groupBy("print").agg(F.min("id").alias("least")))
    found = cut_lineage(links(nodes, distance))
    linked = found.select(F.col("src").alias("node")).union(found.select("dst")).distinct()
    merged = connected_components(linked, found, []).withColumnRenamed("node", "print")
    classes = nodes.join(merged, "print", "left").withColumn("component", F.coalesce("component", "print"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "component").select("print", "component_id")
    return each.join(named, "print", "left").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
