"""Source divergence against plain sums over all terms, in whole numbers; the tree against all pairs of a row."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphloom.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, value string, rank string, n string"


def plainly(rows, min_docs, top=10):
    grams = [
        (lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
        for _, text, lang, source in rows
    ]
    docs, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in grams:
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
    kept = {lang: sorted((t for t, d in c.items() if d >= min_docs), key=str.encode) for lang, c in docs.items()}

    def shares(count, terms):
        total = sum(count[t] for t in terms)
        return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(terms)) for t in terms}

    def ranked(lang, source, part, items, most=None):
        items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
        return [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items)]

    out = []
    own = {g: shares(c, kept[g[0]]) for g, c in counts.items()}
    for lang, source in counts:
        p = own[lang, source]
        others = [s for x, s in counts if x == lang and s != source]
        q = {s: own[lang, s] for s in others}
        out += ranked(lang, source, "pair", [(s, sum((p[t] - q[s][t]) ** 2 // (p[t] + q[s][t]) for t in kept[lang])) for s in others])
        of_lang = shares(langs[lang], kept[lang])
        terms = [(t, (p[t] - of_lang[t]) ** 2 // (p[t] + of_lang[t])) for t in kept[lang] if counts[lang, source][t] and p[t] > of_lang[t]]
        out += ranked(lang, source, "term", terms, top)
    return out


def random_rows(seed, n):
    r = random.Random(seed)
    vocabulary = ["The", "the", "of", "é", "naïve", "中文", "x1y", "Über", "über", *(f"w{chr(97 + k)}" for k in range(26)), *(f"Rare{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(n):
        words = [vocabulary[min(int(r.expovariate(0.15)), len(vocabulary) - 1)] for _ in range(r.choice((0, 1, 5, 40, 200)))]
        rows.append((k, r.choice((" ", "-", "\n", "\x00", "_9[")).join(words), r.choice(("en", "en", "en", "fr", "", None)), r.choice(("a", "a", "a", "B", "é", "", None, "b c"))))
    return rows


ODD = [(1, None, None, None), (2, "", "xx", "only"), (3, "one two", "yy", "p"), (4, "three", "yy", "q"), (4, "three", "yy", "q"), (None, "Same the the", "en", "a"), (5, "word " * 200_000, "en", "long")]


@pytest.mark.parametrize("seed, n, min_docs", [(1, 150, 3), (2, 400, 10), (3, 5, 1), (4, 60, 1000)])
def test_against_plain_sums(spark, seed, n, min_docs):
    rows = random_rows(seed, n) + ODD
    docs = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], DOCS).repartition(3)
    got = divergence.divergence(docs, min_docs=min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(plainly(rows, min_docs))


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("limit", [divergence.COMBINATIONS, 1, 7, 100])
def test_tree_sums_each_pair_of_a_row(monkeypatch, limit):
    monkeypatch.setattr(divergence, "COMBINATIONS", limit)
    r = random.Random(limit)
    zeros = [r.randint(1, 50) for _ in range(9)]
    rows = [sorted((s, r.randint(60, 62), zeros[s]) for s in r.sample(range(9), r.choice((1, 1, 2, 3, 9)))) for _ in range(400)]
    expected = Counter()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for row in rows:
        for k, (s, p, z) in enumerate(row):
            for t, q, y in row[:k]:
                expected[t, s] += f(p, q) - f(p, y) - f(z, q) + f(z, y)
    paths = sorted(Counter(map(tuple, rows)).items())
    starts = np.concatenate([[0], np.cumsum([len(p) for p, _ in paths])])
    sources, shares, zero = (np.array([n[k] for p, _ in paths for n in p], np.int64) for k in range(3))
    terms = np.array([n for _, n in paths], np.int64)
    got = Counter()
    for one, two, value in divergence.tree_corrections(starts, sources, shares, zero, terms):
        for i, j, v in zip(one.tolist(), two.tolist(), value.tolist()):
            got[i, j] += v
    assert +got == +expected and -got == -expected

    prefixes = Counter()
    for p, n in paths:
        for d in range(len(p)):
            prefixes[p[: d + 1]] += n
    path, depth, times = divergence.pattern_tree(starts, sources, shares, terms)
    nodes = [(paths[k][0][: d + 1], n) for k, d, n in zip(path, depth, times)]
    assert sorted(nodes) == sorted(prefixes.items())


def test_no_paths_no_corrections():
    none = np.zeros(0, np.int64)
    assert list(divergence.tree_corrections(np.zeros(1, np.int64), none, none, none, none)) == []
    one = np.array([3], np.int64)
    assert list(divergence.tree_corrections(np.array([0, 1]), one, one, one, one)) == []


def test_shares_are_exact_for_large_counts(spark):
    r = random.Random(9)
    rows = [(r.randint(0, 10**k), 10**k + r.randint(0, 10**k), r.randint(1, 10**5)) for k in range(16)] + [(0, 0, 0), (0, 0, 1), (4 * 10**15, 4 * 10**15, 7)]
    df = spark.createDataFrame(rows, "n long, total long, kept long").withColumn("p", divergence.share("n", "total", "kept"))
    for row in df.collect():
        assert row.p == (1 + 10**9 * (row.n + 2) // (row.total + 2 * row.kept) if row.kept else None)
