"""Near-duplicate classes from bottom-k sketches of one hash function.

The k least shingle hashes of a document are its sketch. Inverted lists of retained values
give candidate pairs, a union-sketch estimate drops most, the full shingle sets decide.

* Documents with equal sets are one node; copies are never paired.
* A node enters the lists of its rarest retained values only: two nodes over the threshold
  share so many values that they meet in one of these (a prefix filter, values ordered by
  how many nodes retain them). Passages that thousands of documents share drop out.
* A list is not paired with itself. First every member meets one member of the list (its
  hub), for a few rounds with other hubs; found classes are merged in between. Then members
  of a list that are still in different classes are compared, by a fixed-size bitmap of
  their sketches inside the join, so that only promising pairs become rows.
* Where pairs are many for their nodes, a part of them is confirmed first; pairs whose nodes
  this joins are through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.llm.common import arrow_rows
from glyphloom.operators.components import connected_components
from glyphloom.session import cut_lineage

SKETCH = 64
"""Least hashes kept for the union-sketch estimate."""
LISTED = 32
"""Least hashes of which the rarest enter inverted lists."""
MAPPED = 256
"""Least hashes that set bits in the bitmap."""
WORDS = 16
"""64-bit words of the bitmap."""
SLACK = 4.5
"""Standard deviations by which a sketch may fall short of what a pair at the threshold has on average."""
HUB_ROUNDS = 2
PAIRS_FIRST = 8
"""Pairs a node that are confirmed before its other pairs, if there are many more."""

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240101).integers(0, 1 << 64, 256 + 64, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    while len(_POWERS[0]) < n:
        old = _POWERS[0]
        _POWERS[0] = np.concatenate([old, old * (old[-1] * _STEP)])
    return _POWERS[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's word windows; A-Z are lower-cased, words end at ASCII white space.

    A text of fewer words is one window of all its words; without words the set is empty.
    """

    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = _SPACES[raw]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.int64)
    at = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw)))) if first[0] == 0 else None
    if at is None:
        raw, space, first = raw[first[0]:], space[first[0]:], first - first[0]
        at = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    values = np.where(space, np.uint64(0), _RANDOM[raw]) * _powers(int(at.max()) + 1)[at]
    word = _mix(np.add.reduceat(values, first))
    n = min(words, len(word))
    windows = np.zeros(len(word) - n + 1, np.uint64)
    for k in range(n):
        windows += word[k : len(word) - n + 1 + k] * _RANDOM[256 + k]
    return np.unique(_mix(windows + np.uint64(n)) >> np.uint64(1)).astype(np.int64)


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    x = hashes.astype(np.uint64)
    return int(_mix(x + _STEP).sum().astype(np.int64)), int(_mix(x * _RANDOM[7]).sum().astype(np.int64))


def sketches(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(row, key, text_key, n, two fingerprints, sketch, bitmap words) per row, from whole texts."""

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            out = []
            for row, doc_id, text_key, value in part:
                h = shingle_hashes(value, words)
                bits = np.zeros(WORDS * 64, np.uint8)
                bits[h[:MAPPED] & (WORDS * 64 - 1)] = 1
                out.append((row, doc_id, text_key, len(h), *_fingerprint(h), h[:SKETCH].tolist(), *np.packbits(bits, bitorder="little").view("<i8").tolist()))
            yield out

    kind = dict(docs.dtypes)[key]
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    bitmap = ", ".join(f"b{k} bigint" for k in range(WORDS))
    return arrow_rows(source, ["row", "id", "text_key", "text"], f"row bigint, id {kind}, text_key bigint, n bigint, print1 bigint, print2 bigint, sketch array<bigint>, {bitmap}", rows)


def _list_places(n: Column, threshold: float) -> Column:
    """How many of its rarest retained values a node of ``n`` shingles enters the lists of."""

    most = LISTED * threshold
    shared = max(1, math.floor(most - SLACK * math.sqrt(most * (1 - threshold))))
    kept = F.least(n, F.lit(LISTED))
    return F.when(n <= math.floor(most), n - F.ceil(n * threshold - 1e-9) + 1).otherwise(kept - shared + 1)


def _may_link(a: str, b: str, threshold: float) -> Column:
    """Sizes and bitmaps of ``a`` and ``b`` allow a similarity of ``threshold``.

    Over the threshold at least t / (1 + t) of both sizes' sum is shared; of the larger
    set's retained values that share is retained on both sides, exactly if all are retained,
    else up to ``SLACK`` deviations. Bitmaps differ in at most the values that aren't shared.
    """

    col = lambda side, name: F.col(f"{side}.{name}")
    small, large = F.least(col(a, "n"), col(b, "n")), F.greatest(col(a, "n"), col(b, "n"))
    part = threshold / (1 + threshold) * (small + large) / large
    kept_small, kept_large = F.least(small, F.lit(MAPPED)), F.least(large, F.lit(MAPPED))
    slack = F.when(large > MAPPED, SLACK * F.sqrt(kept_large * part * F.greatest(1 - part, F.lit(0.0)))).otherwise(0.0)
    differ = sum((F.bit_count(col(a, f"b{k}").bitwiseXOR(col(b, f"b{k}"))) for k in range(1, WORDS)), F.bit_count(col(a, "b0").bitwiseXOR(col(b, "b0"))))
    return (small >= large * threshold - 1e-9) & (differ <= kept_small + kept_large - 2 * (kept_large * part - slack) + 1e-6)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) per row of ``docs``; similar means 100 * shared >= percent * union.

    ``component_id`` is the least key that links reach; ``kept`` marks rows whose key it is.
    Null and wordless texts have an empty set and stand alone. Rows that repeat a key share
    its class and are all kept if it is the least; a null key comes before no other.
    """

    threshold = percent / 100
    each = cut_lineage(sketches(docs, words, key, text))
    node_of = each.filter("n > 0").groupBy("n", "print1", "print2").agg(F.min("row").alias("node"), F.min("id").alias("least"))
    node_of = cut_lineage(node_of)
    nodes = each.join(node_of.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    bits = [f"b{k}" for k in range(WORDS)]
    lists = cut_lineage(_lists(nodes, threshold).join(nodes.select("node", *bits), "node"))
    lists = lists.withColumn("comp", F.col("node"))
    links = None
    for turn in range(HUB_ROUNDS + 1):
        pairs = _hub_pairs(lists, turn, threshold) if turn < HUB_ROUNDS else _open_pairs(lists, threshold)
        pairs, taken = _estimated(cut_lineage(pairs), nodes, threshold), 0.0
        while taken < 1:
            some, taken = _next_pairs(pairs, taken)
            found = _confirmed(docs, some, nodes, words, percent, key, text)
            links = found if links is None else cut_lineage(links.unionByName(found))
            merged = _classes(links)
            if taken < 1:
                pairs = _between_classes(pairs, merged)
        lists = lists.drop("comp").join(merged.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = (
        node_of.join(merged, "node", "left").withColumn("class", F.coalesce("component", "node")).select("n", "print1", "print2", "class", "least")
    )
    smallest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "class").select("n", "print1", "print2", "component_id")
    own = each.select("id", "n", "print1", "print2").join(named, ["n", "print1", "print2"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return own.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _classes(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes that links (a, b) join."""

    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return cut_lineage(connected_components(ends, links.select(F.col("a").alias("src"), F.col("b").alias("dst")), []))


def _next_pairs(pairs: DataFrame, taken: float) -> tuple[DataFrame, float]:
    """Of the pairs beyond the share ``taken`` of all, the next ones to confirm, and the share reached.

    Many pairs of few nodes are mostly links inside one class, which a part of them already joins. So
    about ``PAIRS_FIRST`` pairs a node go first, then ``PAIRS_FIRST`` times that share, until all are through.
    """

    n, nodes = pairs.agg(F.count("*"), F.approx_count_distinct("a")).first()
    first = PAIRS_FIRST * max(1, nodes) / n if n else 1.0
    reached = taken * PAIRS_FIRST if taken else first
    part = _part()
    if reached >= 0.5:
        return pairs.filter(part >= taken), 1.0
    return pairs.filter((part >= taken) & (part < reached)), reached


def _part() -> Column:
    """A place from 0 to 1 that a pair keeps."""

    return F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)) / (1 << 30)


def _between_classes(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """Pairs whose nodes are not in one class yet."""

    of = lambda end: merged.select(F.col("node").alias(end), F.col("component").alias(f"class_{end}"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return cut_lineage(known.filter(~F.coalesce(F.col("class_a") == F.col("class_b"), F.lit(False))).select("a", "b"))


def _lists(nodes: DataFrame, threshold: float) -> DataFrame:
    """(value, node, n, prefix): the rarest retained values of each node that another one retains too."""

    entries = nodes.select("node", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("holders")).filter("holders > 1")
    met = entries.join(shared, "value")
    by_node = W.partitionBy("node")
    places = _list_places(F.col("n"), threshold)
    return (
        met.withColumn("lone", F.least("n", F.lit(LISTED)) - F.count("*").over(by_node))
        .withColumn("place", F.row_number().over(by_node.orderBy("holders", "value")))
        .filter(F.col("place") + F.col("lone") <= places)
        .withColumn("prefix", F.collect_list("value").over(by_node))
        .select("value", "node", "n", "prefix")
    )


def _hub_pairs(lists: DataFrame, turn: int, threshold: float) -> DataFrame:
    """(a, b): members with their list's hub, another one each turn, where classes differ."""

    bits = [f"b{k}" for k in range(WORDS)]
    order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    hubs = lists.groupBy("value").agg(F.min_by(F.struct("node", "n", "comp", *bits), order).alias("h")).select("value", "h.*")
    return (
        lists.alias("m").join(hubs.alias("h"), (F.col("m.value") == F.col("h.value")) & (F.col("m.comp") != F.col("h.comp")) & _may_link("m", "h", threshold))
        .select(F.least("m.node", "h.node").alias("a"), F.greatest("m.node", "h.node").alias("b")).distinct()
    )


def _open_pairs(lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b): members of one list that are still in different classes, each pair in its least common list only."""

    mixed = lists.groupBy("value").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("value")
    left = lists.join(mixed, "value", "left_semi")
    once = F.array_min(F.array_intersect("a.prefix", "b.prefix")) == F.col("a.value")
    differ = (F.col("a.value") == F.col("b.value")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp"))
    return left.alias("a").join(left.alias("b"), differ & _may_link("a", "b", threshold) & once).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose union sketch allows the threshold: the least k of both sketches, and how many both retain."""

    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    met = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    size = F.size("u")
    enough = both >= size * threshold - SLACK * F.sqrt(size * threshold * (1 - threshold))
    return cut_lineage(met.withColumn("u", union).filter(enough).select("a", "b"))


def _confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """Pairs whose full shingle sets meet the threshold. Only texts of nodes in pairs are read into sets."""

    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(needed, "node").select("node", "text_key", "id")
    texts = docs.select(F.xxhash64(text).alias("text_key"), F.col(key).alias("id"), F.col(text).alias("text"))
    chosen = texts.alias("t").join(wanted.alias("w"), (F.col("t.text_key") == F.col("w.text_key")) & F.col("t.id").eqNullSafe(F.col("w.id"))).select("w.node", "t.text")

    def sets_of(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            yield [(node, shingle_hashes(value, words).tobytes()) for node, value in part]

    sets = cut_lineage(arrow_rows(chosen, ["node", "text"], "node bigint, hashes binary", sets_of)).dropDuplicates(["node"])

    def linked(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            out = []
            for a, b, one, two in part:
                x, y = np.frombuffer(one, np.int64), np.frombuffer(two, np.int64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    out.append((a, b))
            yield out

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    return cut_lineage(arrow_rows(both, ["a", "b", "ha", "hb"], "a bigint, b bigint", linked))
