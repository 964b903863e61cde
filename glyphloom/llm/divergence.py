"""How the sources of a language differ in their terms, from a frequent-pattern tree of term rows.

Every group (language, source) and every language gives each kept term a smoothed share; two
shares p and q of a term differ by floor((p - q)^2 / (p + q)). All arithmetic is on whole numbers.

A pair of sources is summed over all kept terms without visiting them all. With z the share of a
term that a source doesn't have, and d the difference of two shares, a term adds

    d(z1, z2)  +  [d(p1, z2) - d(z1, z2)]  +  [d(z1, p2) - d(z1, z2)]  +  joint(p1, p2)

where the first part needs only the number of kept terms, the two in brackets only how often a
source has each count, and the joint correction only terms that both have. Those come from the
tree: a term's nonzero counts in source order are a path, terms with the same counts share the
path and terms that begin alike share its nodes, so a correction between a node and an ancestor
is computed once, times the number of terms below. Trees are built of stretches of the sorted
paths, as arrays of nodes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.llm.common import ship_package
from glyphloom.session import cut_lineage

MIN_DOCS = 10
TOP = 10
SCALE_STEPS, STEP = 3, 1000
"""Shares are of STEP ** SCALE_STEPS = 10**9, divided out step by step, so counts up to 9 * 10**15 stay exact."""
HELD = 700_000
"""Terms of groups that a task holds before it passes their counts on."""
COMBINATIONS = 500_000
"""Combinations of a node and an ancestor that a task works on at once, about."""
RANGED = 6
"""Nodes of a path that ranges go by."""

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
"""Bytes of terms, A-Z lower-cased; all others end a term."""


# ---------------------------------------------------------------- counting


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text in order: runs of ASCII letters (A-Z lower-cased) and of characters beyond ASCII."""

    return (text or "").encode("utf-8").translate(_LETTERS).split()


def term_counts(docs: DataFrame, group: tuple[str, str], text: str) -> DataFrame:
    """(lang, source, term, n, docs) summed over all rows; a row with a null term for every group that occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, found) in held.items():
                # Both counters got their terms in the same order.
                terms = pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string())])
                counts = [pa.array([0, *c.values()], pa.int64()) for c in (n, found)]
                whole = pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), terms, *counts], names=["lang", "source", "term", "n", "docs"])
                yield from (whole.slice(at, 1 << 15) for at in range(0, len(terms), 1 << 15))
            held.clear()

        for batch in batches:
            for lang, source, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, found = held[lang or "", source or ""]
                before = len(n)
                terms = terms_of(value.as_py())
                n.update(terms)
                found.update(dict.fromkeys(terms).keys())
                size += len(n) - before
                if size > HELD:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    source = docs.select(F.col(group[0]).cast("string").alias("lang"), F.col(group[1]).cast("string").alias("source"), F.col(text).alias("text"))
    ship_package(docs.sparkSession)
    counted = source.mapInArrow(rows, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- arithmetic


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * kept)) by long division; null without kept terms."""

    whole = F.expr(f"{total} + 2 * {kept}")
    quotient, rest = F.lit(0).cast("long"), F.expr(f"{n} + 2").cast("long")
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        quotient = quotient * STEP + _div(rest, whole)
        rest = rest % whole
    return F.when(F.col(kept) > 0, quotient + 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


# ---------------------------------------------------------------- tree of term rows


def pattern_tree(starts: np.ndarray, sources: np.ndarray, shares: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of sorted paths as (path, depth, terms) of its nodes; path k is the stretch from ``starts[k]`` to ``starts[k + 1]``.

    A path adds the nodes beyond what it shares with the one before; the terms of a node are those
    of the paths from there on, up to the next one that leaves the tree above the node.
    """

    sizes = np.diff(starts)
    shared = np.zeros(len(sizes), np.int64)  # how many nodes each path shares with the one before
    open_ = np.arange(1, len(sizes))
    while len(open_):
        depth = shared[open_]
        open_ = open_[(depth < sizes[open_]) & (depth < sizes[open_ - 1])]
        here, before = starts[open_] + shared[open_], starts[open_ - 1] + shared[open_]
        open_ = open_[(sources[here] == sources[before]) & (shares[here] == shares[before])]
        shared[open_] += 1
    path = np.repeat(np.arange(len(sizes)), sizes - shared)
    depth = np.arange(len(path)) - np.repeat(np.cumsum(sizes - shared) - sizes, sizes - shared)
    # The next path that shares no more than a node's depth ends the node: a node of the stack of open ones.
    order = np.lexsort((path, depth))
    end = np.full(len(path), len(sizes))
    for d in range(int(depth.max(initial=-1)) + 1):
        nodes = order[np.searchsorted(depth[order], d) : np.searchsorted(depth[order], d, "right")]
        leaves = np.append(np.flatnonzero(shared <= d), len(sizes))
        end[nodes] = leaves[np.searchsorted(leaves, path[nodes], "right")]
    total = np.concatenate([[0], np.cumsum(terms)])
    return path, depth, total[end] - total[path]


def tree_corrections(starts: np.ndarray, sources: np.ndarray, shares: np.ndarray, zeros: np.ndarray, terms: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, value) of a tree's nodes with all their ancestors, added up by pair, a bounded number of combinations at a time."""

    path, depth, times = pattern_tree(starts, sources, shares, terms)
    node = starts[path] + depth
    pieces = np.searchsorted(np.cumsum(depth), np.arange(COMBINATIONS, int(depth.sum()) + COMBINATIONS, COMBINATIONS)) + 1
    for a, b in zip(np.concatenate([[0], pieces[:-1]]), pieces):
        up = depth[a:b]
        k = np.repeat(node[a:b], up)
        j = np.repeat(starts[path[a:b]] - np.cumsum(up) + up, up) + np.arange(len(k))
        p, z, q, y = shares[k], zeros[k], shares[j], zeros[j]
        joint = (_difference(p, q) - _difference(p, y) - _difference(z, q) + _difference(z, y)) * np.repeat(times[a:b], up)
        one, two = np.minimum(sources[k], sources[j]), np.maximum(sources[k], sources[j])
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(order) else order
        if len(first):
            yield one[first], two[first], np.add.reduceat(joint[order], first)


def joint_corrections(paths: DataFrame) -> DataFrame:
    """(lang, i, j, value): joint corrections of sources i and j of a language, from rows (lang, path, terms).

    Paths are dealt by ranges and sorted, so terms that begin alike meet in one batch's tree; a path
    that a border cuts off is only added up in two trees. Ranges go by a path's first RANGED nodes,
    which is all that the driver sees of a sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, terms = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            starts = lists.offsets.to_numpy().astype(np.int64)
            fields = [lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
            cuts = [0, *(k for k in range(1, len(langs)) if langs[k] != langs[k - 1]), len(langs)]
            for a, b in zip(cuts, cuts[1:]):
                for one, two, value in tree_corrections(starts[a : b + 1], *fields, terms[a:b]):
                    arrays = [pa.repeat(langs[a], len(one)), *(pa.array(c, pa.int64()) for c in (one, two, value))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "i", "j", "value"])

    ship_package(paths.sparkSession)
    head = F.slice("path", 1, RANGED)
    by_path = paths.repartitionByRange("lang", head["i"], head["p"]).sortWithinPartitions("lang", "path")
    return by_path.select("lang", "path", "terms").mapInArrow(run, "lang string, i bigint, j bigint, value bigint")


# ---------------------------------------------------------------- audit


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank): how every source of a language differs from the others and in which terms.

    Part ``pair``: every other source of the language, by the difference summed over all kept terms
    (0 if there are none). Part ``term``: the ``top`` terms that the source has a larger share of
    than its language. A language keeps the terms that ``min_docs`` of its rows hold. Ranks go by
    value, then by the item's bytes. Nulls in text, language and source are empty strings, and the
    empty string is a language or source like any other; a group without any term is still a
    group; repeated rows count as often as they occur. An empty table gives no rows. Other columns
    aren't read.
    """

    counts = cut_lineage(term_counts(docs, (lang, source), text))
    terms = counts.filter("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    kept = cut_lineage(kept)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    found = cut_lineage(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    groups = cut_lineage(_groups(counts, found, langs))
    entries = cut_lineage(
        found.join(groups, ["lang", "source"])
        .withColumn("p", share("n", "total", "kept"))
        .withColumn("q", share("lang_n", "lang_total", "kept"))
        .select("lang", "source", "i", "term", "p", "z", "q")
    )
    result = _pairs(groups, entries).unionByName(_top_terms(entries, top))
    return result.select("lang", "source", "part", "item", "value", "rank")


def _groups(counts: DataFrame, found: DataFrame, langs: DataFrame) -> DataFrame:
    """A row for each group: its place among its language's sources (most kept terms first), totals, and share without a term."""

    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    occurring = counts.filter("term IS NULL").select("lang", "source")
    rows = occurring.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "kept", "lang_total"])
    by_terms = W.partitionBy("lang").orderBy(F.desc("terms"), "source")
    return (
        rows.withColumn("i", F.row_number().over(by_terms).cast("long"))
        .withColumn("nothing", F.lit(0).cast("long"))
        .withColumn("z", share("nothing", "total", "kept"))
        .drop("nothing", "terms")
    )


def _pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """All pairs of a language's sources, which the result has to hold, with values from counts of counts and the tree."""

    one = groups.select("lang", "i", F.col("z").alias("zi"), "kept")
    two = groups.select("lang", F.col("i").alias("j"), F.col("z").alias("zj"), F.col("source").alias("item"))
    z, y = F.col("zi"), F.col("zj")
    base = one.join(two, "lang").filter("i < j").select("lang", "i", "j", F.when(F.col("kept") > 0, F.col("kept") * difference(z, y)).otherwise(0).alias("value"))
    shares = entries.groupBy("lang", "i", "p").agg(F.count("*").alias("terms"), F.first("z").alias("zi"))
    single = (
        shares.join(two, "lang")
        .filter("i <> j")
        .select("lang", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), ((difference(F.col("p"), y) - difference(z, y)) * F.col("terms")).alias("value"))
    )
    paths = (
        entries.groupBy("lang", "term")
        .agg(F.array_sort(F.collect_list(F.struct("i", "p", "z"))).alias("path"))
        .groupBy("lang", "path")
        .agg(F.count("*").alias("terms"))
        .filter(F.size("path") > 1)
    )
    joint = joint_corrections(cut_lineage(paths))
    sums = base.unionByName(single).unionByName(joint).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    sums = cut_lineage(sums)
    both = sums.unionByName(sums.select("lang", F.col("i").alias("j"), F.col("j").alias("i"), "value"))
    named = both.join(groups.select("lang", "i", "source"), ["lang", "i"]).join(two.select("lang", "j", "item"), ["lang", "j"])
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))


def _top_terms(entries: DataFrame, top: int) -> DataFrame:
    value = difference(F.col("p"), F.col("q"))
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    return above.withColumn("rank", ranked).filter(F.col("rank") <= top)


ORACLE = """
WITH docs AS (
    SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10
), langs AS (
    SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
    SELECT lang, source, (SELECT coalesce(sum(n), 0)::BIGINT FROM counts AS c WHERE c.lang = g.lang AND c.source = g.source) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) AS g
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
    FROM groups AS g JOIN langs AS l USING (lang) JOIN kept AS k USING (lang) LEFT JOIN counts AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
