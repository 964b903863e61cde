"""Values beyond the usual: very long shapes, dates of all years, ids over 2**53, wide components."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import pii, topk

UNITS = ["a.", "a", "1 ", "1-", "4 4 ", ".", "-", "@", "@a.b", "0.", "12-", "F", "A1B2 ", "+1 ", "(12) ", "a..", "2020-01-01 ", "é"]


@pytest.mark.parametrize("before", ["", "bob@"])
def test_long_repetitions_of_every_shape_return(spark, before):
    rows = [(k, before + unit * 200_000) for k, unit in enumerate(UNITS) if unit not in ("@a.b", "2020-01-01 ") or not before]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.n for r in pii.pseudonymised(docs, found="n").select("doc_id", "n", F.length("text").alias("l")).collect()}
    assert len(got) == len(rows)
    if not before:
        assert got[UNITS.index("2020-01-01 ")] == 200_000


def test_addresses_end_where_their_labels_do(spark):
    cases = {
        "mail bob@a.b.c. Then": "bob@a.b.c", "bob@x.a..b@c.d": "bob@x.a", "x@y-z.co..2021-03-04 on": "x@y-z.co", "a@b.c-": "a@b.c-", "a@b": None, "a@b..c": None, "a@.b.c": None,
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymised(docs).collect()}
    for k, (text, address) in enumerate(cases.items()):
        if address is None:
            assert out[k] == text
        else:
            head, _, tail = text.partition(address)
            found = re.match(re.escape(head) + r"user[0-9a-f]{16}@mail\.invalid", out[k])
            assert found and (out[k][found.end() :] == tail or any(c in tail for c in "@2"))
            assert "2021-03-04" not in out[k]


@pytest.mark.parametrize("first", ["0000-01-01", "0150-06-01", "0199-12-01", "0200-01-01", "1599-12-01", "1799-12-01", "2199-12-25", "2250-01-01", "9799-12-20", "9999-11-20"])
def test_dates_of_all_years_move_inside_their_cycle(spark, first):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    before = [r.text for r in docs.orderBy("doc_id").collect()]
    after = [r.text for r in pii.pseudonymised(docs).orderBy("doc_id").collect()]
    assert len(set(after)) == 40 and all(re.fullmatch(r"\d{4}-\d\d-\d\d", t) for t in after) and before != after
    cycle = lambda t: "edge" if not 200 <= int(t[:4]) < 9800 else (int(t[:4]) - 200) // 400
    assert [cycle(t) for t in before] == [cycle(t) for t in after]


def test_the_first_and_last_half_cycle_are_permuted_together(spark):
    starts = spark.range(pii.DAYS).select(F.col("id").cast("int").alias("k"))
    day = F.when(F.col("k") < pii.HALF_CYCLE, F.date_add(F.lit("9800-01-01").cast("date"), F.col("k"))).otherwise(
        F.date_add(F.lit("0000-01-01").cast("date"), F.col("k") - pii.HALF_CYCLE)
    )
    moved = starts.select(pii._moved_day(day, "k").alias("d")).agg(F.countDistinct("d").alias("n"), F.min(F.year("d")).alias("a"), F.max(F.year("d")).alias("b")).first()
    assert tuple(moved) == (pii.DAYS, 0, 9999)


def plain_top(rows, k=5):
    import math

    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(usable):
        if i is not None and i % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, c) for c, (j, w) in enumerate(usable) if c != q]
            out += [(i, n + 1, None if s[1] else s[2], -s[0]) for n, s in enumerate(sorted(scores)[:k])]
    return out


def test_ids_over_two_to_the_53(spark):
    base = 1 << 60
    rows = [(base - base % 50, [1.0, 0.5])] + [(base + k, [1.0, 0.0]) for k in range(1, 13) if (base + k) % 50] + [(None, [1.0, 0.0])]
    random.Random(3).shuffle(rows)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_top(rows))


def test_wide_components_and_empty_vectors(spark):
    r = random.Random(8)
    rows = [(k, [r.choice((70000.0, -70000.5, 3.25, 1e6)) * r.random() for _ in range(6)]) for k in range(0, 160)] + [(200, []), (201, []), (250, None), (300, [float("nan")])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_top(rows))
    with pytest.raises(ValueError, match="may not fit"):
        topk.top_k(spark.createDataFrame([(0, [1e8] * 9)], "vec_id long, embedding array<double>"))
