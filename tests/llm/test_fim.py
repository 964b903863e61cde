"""Fill-in-the-middle: the skip list against plain sums, outputs against plain slices, odd rows, other units and marks."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import fim

DOCS = "doc_id long, text string, lang string, n string, form string, output string, key string"
ODD = [
    (1, "plain words here"), (2, "é🎉\x00\x1c\nx" * 50), (3, None), (4, ""), (5, "a"), (5, "a"), (5, "other"), (None, "no id at all"), (6, "has <M> inside"),
    (7, "<P"), (8, "<" * 40), (9, "x" * 300_000), (10, "🤦🏼‍♂️ é"), *((k, f"text number {k} " * (k % 7)) for k in range(11, 200)),
]


def plainly(doc_id, text, cut=list):
    text = text or ""
    units = cut(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 1000, 70_000, 200_001])
def test_skip_list_reaches_every_rank(n):
    r = random.Random(n)
    widths = np.array([r.randint(1, 9) for _ in range(n)], np.int64)
    units = fim.SkipList(widths)
    sums = np.concatenate([[0], np.cumsum(widths)])
    for rank in {0, n, *(r.randint(0, n) for _ in range(60))}:
        assert units.points_before(rank) == sums[rank]
    for lane in range(len(units.units)):
        passed = units.units[lane].sum(dtype=np.int64)
        assert units.points[lane].sum(dtype=np.int64) == sums[passed] and len(units.units[lane]) == len(units.points[lane])
    for rank in (-1, n + 1):
        with pytest.raises(IndexError):
            units.points_before(rank)
    if n > 1000:
        assert len(units.units) > 2


def test_outputs_and_restored_texts(spark):
    docs = spark.createDataFrame([(i, t, "en", *["clash"] * 4) for i, t in ODD], DOCS).repartition(3)
    made = fim.fill_in_middle(docs)
    rows = made.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == sorted((plainly(i, t) for i, t in ODD), key=repr)
    assert sorted((r.doc_id, r.back) for r in rows if r.doc_id is not None) == sorted((i, t or "") for i, t in ODD if i is not None)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    digests = fim.fim_digests(docs).collect()
    assert all(len(r.output_sha256) == 64 and r.restored_sha256 for r in digests) and len(digests) == len(ODD)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0 and fim.fim_digests(docs.limit(0)).count() == 0


def test_words_as_units_keep_gaps(spark):
    def words(text):
        ends = [m.end() for m in re.finditer(r"\w+", text)]
        cuts = [0, *ends[:-1], len(text)] if text else [0]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    rows = [(k, "  one two, three…\n four " * (k % 5) + "!") for k in range(60)] + [(60, "!?"), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.fill_in_middle(docs, unit=r"\w+").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((plainly(i, t, words) for i, t in rows), key=repr)


def test_marks_that_run_into_each_other_are_refused(spark):
    docs = spark.createDataFrame([("1", "abc.d" * 9)], "doc_id string, text string")
    for marks in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "x"), ("aa", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, marks=marks)
    marks = ("[.(", "|*", "\\E?")
    made = fim.fill_in_middle(docs, marks=marks, fim_percent=100)
    assert [r.t for r in made.select(fim.restored(F.col("form"), F.col("output"), marks).alias("t")).collect()] == ["abc.d" * 9]
