"""SimHash classes against all pairs: fingerprints, cells, blocks, large groups of near copies, odd rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphloom.llm import simhash

DOCS = "doc_id long, text string, lang string, print string, grid string, node string, component_id string"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    windows = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in windows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, least, distance=4):
    """Smallest id that links of fingerprints reach, by comparing all of them."""

    values = np.array(prints, np.uint64)
    comp = np.arange(len(values))
    for k in range(len(values)):
        for other in np.flatnonzero(np.bitwise_count(values[k:] ^ values[k]) <= distance) + k:
            if comp[other] != comp[k]:
                comp[comp == comp[other]] = comp[k]
    smallest = {}
    for c, i in zip(comp, least):
        if i is not None:
            smallest[c] = min(i, smallest.get(c, i))
    return [smallest.get(c) for c in comp]


def near_texts(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = []
    for k in range(n):
        words = list(base) if k % 3 else ["".join(r.choice("klmnop") for _ in range(5)) for _ in range(r.randint(1, 40))]
        for _ in range(k % 9):
            words[r.randrange(len(words))] = f"new{r.randint(0, 99)}"
        rows.append((k + 10, " ".join(words)))
    return rows


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One TWO three"), (5, "one two\x0bthree"), (5, "one two three"), (6, "É one two three four"), (7, "é one two three four"),
    (None, "one two three"), (None, "no one else has this text at all"), (8, "a\x1cb\x85c\xa0d e f"), (9, "word " * 150_000), *near_texts(1, 120),
]


def test_documents_against_all_pairs(spark):
    docs = spark.createDataFrame([(i, t, "en", *["clash"] * 4) for i, t in ODD], DOCS).repartition(4)
    rows = simhash.near_fingerprints(docs).collect()
    prints = [plain_fingerprint(t) for _, t in ODD]
    expected = [(i, f"{p:016x}", c) for (i, _), p, c in zip(ODD, prints, plain_classes(prints, [i for i, _ in ODD]))]
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    assert len({c for _, _, c in expected}) < len(ODD) - 20
    assert simhash.near_fingerprints(docs.limit(0)).count() == 0


def around(r, centre, n, flips):
    return {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, flips))) for _ in range(n)}


@pytest.mark.parametrize("block", [simhash.BLOCK, 50])
def test_links_of_crowded_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(7)
    prints = {0, (1 << 64) - 1, 1 << 63, 0xF, 0x1F}
    for centre in (r.getrandbits(64), r.getrandbits(64), 0):
        prints |= around(r, centre, 700, 9)
    prints |= around(r, r.getrandbits(64), 300, 3) | {r.getrandbits(64) for _ in range(1500)}
    chain = r.getrandbits(64)
    for k in range(16):  # each four bits on from the one before
        prints.add(chain := chain ^ (0xF << (4 * k)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    found = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.links(nodes).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    comp = {p: p for p in prints}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in found:
        comp[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(p) for p in prints] == plain_classes(prints, prints)


def test_manhattan_distance_bounds_hamming_distance(spark):
    r = random.Random(3)
    pairs = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(200)]
    for a, b in pairs:
        pa, pb = simhash._points(np.array([a, b], np.uint64))
        plain = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert int(np.bitwise_count(pa ^ pb)) == plain <= (a ^ b).bit_count()
    signed = spark.createDataFrame([(a - (1 << 64) if a >> 63 else a,) for a, _ in pairs], "p long")
    got = [r.q % (1 << 64) for r in signed.select(simhash._point(F.col("p")).alias("q")).collect()]
    assert got == simhash._points(np.array([a for a, _ in pairs], np.uint64)).tolist()


def test_other_distances_keep_all_links(spark):
    r = random.Random(11)
    prints = sorted(around(r, r.getrandbits(64), 200, 6) | around(r, r.getrandbits(64), 200, 12))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    for distance in (0, 1, 6):
        comp = plain_classes(prints, prints, distance)
        found = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.links(nodes, distance).collect()]
        named = dict(zip(prints, comp))
        assert all((a ^ b).bit_count() <= distance and named[a] == named[b] for a, b in found)
        assert len({a for a, _ in found} | {b for _, b in found}) == sum(comp.count(c) > 1 for c in comp)


def test_forest_is_small_and_spans():
    r = random.Random(5)
    prints = np.array(sorted(around(r, r.getrandbits(64), 3000, 4)), np.uint64)
    found = simhash._forest(prints, 4)
    edges = sum(len(a) for a, _ in found)
    assert edges == len(prints) - len(set(plain_classes(prints.tolist(), prints.tolist())))
