"""Near-dedup over a dense group: a part of its pairs settles the classes, which stay the exact ones."""

from __future__ import annotations

import random

import numpy as np

from glyphloom.llm import neardup


def test_pairs_inside_one_class_are_not_confirmed_again(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for doc in range(120):
        words = list(base)
        for at in rng.sample(range(300), rng.choice([2, 3, 4, 9])):
            words[at] = f"x{rng.random()}"
        rows.append((doc, " ".join(words)))
    sets = [neardup.shingle_hashes(text, 5) for _, text in rows]
    least = list(range(120))
    for a in range(120):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = least[a], least[b]
                least = [min(x, y) if c in (x, y) else c for c in least]

    estimated, confirmed = neardup._estimated, neardup._confirmed
    promising, checked = [], []
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 0)
    monkeypatch.setattr(neardup, "_estimated", lambda *a: promising.append((out := estimated(*a)).count()) or out)
    monkeypatch.setattr(neardup, "_confirmed", lambda docs, pairs, *a: checked.append(pairs.count()) or confirmed(docs, pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 5, 80).collect()}
    assert out == dict(enumerate(least))
    assert len(set(least)) > 1 and len(checked) > 1 and sum(checked) < 0.6 * sum(promising)
