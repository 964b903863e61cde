import random

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphloom.operators import bands, sweeps
from glyphloom.operators import ink as I
from glyphloom.operators import layout as Y
from glyphloom.operators.components import contracted_components
from glyphloom.operators.rows import visible_predictions
from glyphloom.plans import page_layout
from glyphloom.plans import standins as T
from glyphloom.plans.ink_catalog import character_regions

BOX = "page_id int, box_id int, x0 int, y0 int, x1 int, y1 int, width int, height int"
INK = "page_id int, y int, x int"


def pages(seed, n_pages, n_boxes, sizes=(3, 40), pitch=60, width=300, height=200):
    rng = random.Random(seed)
    out = {}
    for p in range(n_pages):
        boxes = []
        for i in range(n_boxes):
            x0, y0 = rng.randrange(0, width - 50), rng.choice(range(10, height - 60, pitch)) + rng.randrange(0, 18)
            boxes.append((x0, y0, x0 + rng.randrange(*sizes), y0 + rng.randrange(*sizes)))
        out[p] = list(dict.fromkeys(boxes))
    return out


def fill(boxes, step=2):
    return {(y, x) for b in boxes for y in range(b[1], b[3], step) for x in range(b[0], b[2])}


def frames(spark, by_page, ink_by_page, width=300, height=200):
    boxes = spark.createDataFrame(
        [(p, i, *b, width, height) for p, bs in by_page.items() for i, b in enumerate(bs)], BOX)
    ink = spark.createDataFrame([(p, y, x) for p, px in ink_by_page.items() for y, x in px], INK)
    return boxes.repartition(5), ink.repartition(5)


def as_sets(df, columns=("x0", "y0", "x1", "y1")):
    out = {}
    for r in df.collect():
        out.setdefault(r.page_id, []).append(tuple(r[c] for c in columns))
    return {p: sorted(v) for p, v in out.items()}


def test_reading_order_of_separate_lines(spark):
    """Lines far apart in y are the rows, whatever the order of input; within a line x decides."""

    rng = random.Random(1)
    data, lines = {}, {}
    for p in range(20):
        lines[p] = [[(x, 100 * k + rng.randrange(6), x + 20, 100 * k + 40) for x in sorted(rng.sample(range(0, 400, 25), rng.randint(1, 7)))] for k in range(4)]
        data[p] = [b for line in lines[p] for b in line]
        rng.shuffle(data[p])
    boxes, _ = frames(spark, data, {0: [(0, 0)]})
    got = {}
    for r in Y.assign_rows(boxes).collect():
        got.setdefault(r.page_id, {}).setdefault(r.row, []).append((r.place, (r.x0, r.y0, r.x1, r.y1)))
    assert {p: [[b for _, b in sorted(got[p][k])] for k in sorted(got[p])] for p in got} == lines


def test_two_rows_of_two(spark):
    boxes, _ = frames(spark, {0: [(60, 12, 80, 40), (10, 10, 30, 40), (12, 90, 30, 120), (62, 91, 80, 119)]}, {0: [(0, 0)]})
    out = Y.assign_rows(boxes).orderBy("row", "place").collect()
    assert [(r.row, r.x0) for r in out] == [(1, 10), (1, 60), (2, 12), (2, 62)]


def test_padding_stops_at_neighbours(spark):
    boxes, _ = frames(spark, {0: [(10, 10, 30, 50), (33, 10, 60, 50)]}, {0: [(0, 0)]}, width=62)
    out = Y.padded_boxes(Y.assign_rows(boxes)).orderBy("place").collect()
    assert [(r.px0, r.py0, r.px1, r.py1) for r in out] == [(4, 4, 33, 56), (30, 4, 62, 56)]


def bounds(px):
    ys, xs = [p[0] for p in px], [p[1] for p in px]
    return min(xs), min(ys), max(xs) + 1, max(ys) + 1


def inside(ink, b):
    return [(y, x) for y, x in ink if b[0] <= x < b[2] and b[1] <= y < b[3]]


def test_wide_boxes_split_into_tight_disjoint_pieces(spark):
    rng = random.Random(5)
    data, ink = {}, {}
    for p in range(25):
        w, h = rng.randrange(40, 170), rng.randrange(18, 60)
        x0, y0 = rng.randrange(0, 60), rng.randrange(0, 60)
        ink[p] = {(y, x) for x in range(x0, x0 + w) for y in range(y0, y0 + h) if rng.random() < 0.15 + 0.5 * ((x // 9) % 3 > 0)}
        data[p] = [(x0, y0, x0 + w, y0 + h)]
    boxes, pixels = frames(spark, data, ink)
    got = as_sets(Y.split_wide_boxes(boxes, pixels))
    for p, (box,) in data.items():
        pieces = got[p]
        if pieces == [box]:
            continue
        assert len(pieces) <= 4
        assert all(pieces[k][2] <= pieces[k + 1][0] for k in range(len(pieces) - 1))
        assert all(bounds(inside(ink[p], piece)) == piece and len(inside(ink[p], piece)) >= 12 for piece in pieces)
        assert len(inside(ink[p], box)) - sum(len(inside(ink[p], piece)) for piece in pieces) < 12 * 4
    assert any(len(v) > 1 for v in got.values())


def test_a_clear_gap_is_where_a_wide_box_is_cut(spark):
    ink = {0: {(y, x) for y in range(40) for x in [*range(0, 30), *range(36, 66)]}, 1: {(y, x) for y in range(40) for x in range(0, 50)}}
    boxes, pixels = frames(spark, {0: [(0, 0, 66, 40)], 1: [(0, 0, 50, 40)]}, ink)
    got = as_sets(Y.split_wide_boxes(boxes, pixels))
    assert len(got[0]) >= 2 and any(b[0] == 36 for b in got[0]) and any(b[2] == 30 for b in got[0])
    assert got[1] == [(0, 0, 50, 40)]


def test_trimmed_overlaps_meet_in_one_column(spark):
    data = pages(7, 25, 9, sizes=(15, 70), pitch=60)
    boxes, pixels = frames(spark, data, {p: fill(bs, 3) for p, bs in data.items()})
    out = as_sets(Y.trim_overlaps(boxes, pixels))
    moved = 0
    for p, bs in data.items():
        before, after = sorted(bs), sorted(out[p])
        rows = lambda boxes: sorted((b[1], b[3]) for b in boxes)
        assert len(after) == len(before) and rows(after) == rows(before)
        starts, ends = {b[0] for b in after} - {b[0] for b in before}, {b[2] for b in after} - {b[2] for b in before}
        assert starts <= {b[2] for b in after} and ends <= {b[0] for b in after}
        moved += len(starts)
    assert moved


def test_overlaps_below_the_limit_stay(spark):
    data = {0: [(0, 0, 40, 40), (38, 0, 80, 40)], 1: [(0, 0, 40, 40), (30, 0, 80, 40)]}
    ink = {p: {(y, x) for y in range(40) for x in [*range(0, 33), *range(37, 80)]} for p in data}
    boxes, pixels = frames(spark, data, ink)
    out = as_sets(Y.trim_overlaps(boxes, pixels))
    assert out[0] == data[0]
    (a, b) = out[1]
    assert a[2] == b[0] and 30 <= b[0] <= 40


def test_merged_parts_are_hulls_of_whole_boxes(spark):
    data = pages(11, 40, 12, sizes=(8, 34), pitch=45)
    ink = {p: fill(bs) for p, bs in data.items()}
    boxes, pixels = frames(spark, data, ink)
    got = as_sets(Y.merge_broken_parts(boxes, pixels))
    again = as_sets(Y.merge_broken_parts(boxes.repartition(3, "x1"), pixels.repartition(2)))
    assert got == again and sum(map(len, got.values())) < sum(map(len, data.values()))
    for p, bs in data.items():
        edges = [{b[k] for b in bs} for k in range(4)]
        assert all(b[k] in edges[k] for b in got[p] for k in range(4))
        assert all(any(g[0] <= b[0] and g[1] <= b[1] and b[2] <= g[2] and b[3] <= g[3] for g in got[p]) for b in bs)


def test_parts_side_by_side_or_stacked_join(spark):
    data = {0: [(0, 0, 30, 40), (32, 0, 48, 40)], 1: [(0, 0, 30, 30), (0, 33, 30, 45)], 2: [(0, 0, 20, 40), (90, 0, 110, 40)], 3: [(0, 0, 20, 40), (24, 0, 26, 8)]}
    boxes, pixels = frames(spark, data, {p: fill(bs, 1) for p, bs in data.items()})
    got = as_sets(Y.merge_broken_parts(boxes, pixels))
    assert got == {0: [(0, 0, 48, 40)], 1: [(0, 0, 30, 45)], 2: data[2], 3: data[3]}


def test_attached_marks_leave_hulls(spark):
    data = pages(13, 60, 12, sizes=(3, 30), pitch=45)
    boxes, pixels = frames(spark, data, {p: fill(bs) for p, bs in data.items()})
    ordered = Y.assign_rows(boxes)
    got = as_sets(Y.attach_small_marks(ordered, pixels))
    assert got == as_sets(Y.attach_small_marks(ordered.repartition(3, "y1"), pixels.repartition(2)))
    assert sum(map(len, got.values())) < sum(map(len, data.values()))
    for p, bs in data.items():
        edges = [{b[k] for b in bs} for k in range(4)]
        assert all(b[k] in edges[k] for b in got[p] for k in range(4))
        assert all(any(g[0] <= b[0] and g[1] <= b[1] and b[2] <= g[2] and b[3] <= g[3] for g in got[p]) for b in bs)


def test_a_near_dot_attaches_and_a_far_one_stays(spark):
    data = {0: [(50, 40, 80, 90), (60, 22, 68, 30)], 1: [(50, 40, 80, 90), (200, 40, 208, 48)]}
    boxes, pixels = frames(spark, data, {p: fill(bs, 1) for p, bs in data.items()})
    got = as_sets(Y.attach_small_marks(Y.assign_rows(boxes), pixels))
    assert got == {0: [(50, 22, 80, 90)], 1: data[1]}


def pieces_of(spark, regions, ink):
    r = spark.createDataFrame(regions, "region_id string, x0 int, y0 int, width int, height int")
    i = spark.createDataFrame(ink, "region_id string, y int, x int").repartition(6)
    got = {}
    for row in Y.split_touching(r, i).collect():
        got.setdefault(row.region_id.split("/")[0], []).append((row.x0, row.y0, row.width, row.height))
    return {k: sorted(v) for k, v in got.items()}


def test_touching_pieces_are_tight_and_disjoint(spark):
    rng = random.Random(3)
    regions, ink = {}, {}
    for p in range(30):
        w, h = rng.randrange(45, 260), rng.randrange(40, 90)
        cuts = sorted(rng.sample(range(w // 4, 3 * w // 4), rng.choice([1, 2, 3])))
        sizes = [rng.choice([3, 8, 14]) for _ in cuts]
        px = set()
        for x in range(w):
            gap = any(abs(x - b) < size for b, size in zip(cuts, sizes))
            px |= {(y, x) for y in range(rng.choice([0, 0, 1]) if gap else rng.randrange(h // 2, h))}
        regions[f"r{p}"], ink[f"r{p}"] = (7, 9, w, h), px
    got = pieces_of(spark, [(k, *v) for k, v in regions.items()], [(k, y, x) for k, px in ink.items() for y, x in px])
    for k, pieces in got.items():
        if pieces == [regions[k]]:
            continue
        assert 2 <= len(pieces) <= 8
        assert all(a[0] + a[2] <= b[0] for a, b in zip(pieces, pieces[1:]))
        for x0, y0, w, h in pieces:
            own = inside(ink[k], (x0 - 7, y0 - 9, x0 - 7 + w, y0 - 9 + h))
            assert bounds(own) == (x0 - 7, y0 - 9, x0 - 7 + w, y0 - 9 + h)
    assert any(len(v) > 2 for v in got.values()) and set(got) == set(regions)


def test_two_blobs_with_a_blank_between_are_two_pieces(spark):
    blobs = [("two", y, x) for y in range(60) for x in [*range(0, 40), *range(54, 94)]] + [("one", y, x) for y in range(60) for x in range(40)]
    got = pieces_of(spark, [("two", 100, 10, 94, 60), ("one", 0, 0, 40, 60)], blobs)
    assert got == {"two": [(100, 10, 40, 60), (154, 10, 40, 60)], "one": [(0, 0, 40, 60)]}


def test_components_equal_flood_fill(spark):
    rng = random.Random(9)
    ink = {p: {(rng.randrange(0, 60), rng.randrange(0, 150)) for _ in range(220)} for p in range(8)}
    ink[8] = {(y, x) for y in range(0, 60) for x in (10 + (y // 3) % 2, 40)} | {(59, x) for x in range(10, 41)}
    # A tall page of many bands: a spiral, a comb that joins only at the bottom, a ring, steps that meet at corners.
    ink[9] = {(y, x) for y in range(0, 400) for x in (5, 25, 45, 65)} | {(399, x) for x in range(5, 66)}
    ink[9] |= {(y, 100) for y in range(50, 330)} | {(329, x) for x in range(100, 180)} | {(y, 179) for y in range(100, 330)} | {(100, x) for x in range(130, 180)} | {(y, 130) for y in range(100, 270)}
    ink[9] |= {(y, x) for y in range(120, 140) for x in range(210, 240) if not (123 < y < 136 and 213 < x < 236)} | {(300 + k, 250 + k) for k in range(80)}
    ink[10] = {(y, x) for y in (63, 64, 127, 128, 191) for x in range(0, 90) if rng.random() < 0.7}
    ink[11] = {(rng.randrange(0, 900), rng.randrange(0, 60)) for _ in range(2500)}
    df = spark.createDataFrame([(p, y, x) for p, px in ink.items() for y, x in px], INK).repartition(4)
    for grow in (0, 1, 2):
        wanted = {}
        for p, px in ink.items():
            boxes = []
            for group in brute.components(px, grow, 10**6, 10**6):
                own = [q for q in group if q in px]
                xs, ys = [q[1] for q in own], [q[0] for q in own]
                b = (min(xs), min(ys), max(xs) + 1, max(ys) + 1)
                if len(group) >= 4 and len(own) >= 4 and (b[2] - b[0]) * (b[3] - b[1]) >= 20:
                    boxes.append(b)
            wanted[p] = sorted(boxes)
        got = as_sets(I.component_boxes(df, min_pixels=4, dilation=grow))
        assert got == {p: v for p, v in wanted.items() if v}


def test_contraction_finds_long_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(1, k, k + 1) for k in range(3000)] + [(1, 10_000, 10_000 + k) for k in range(1, 900)] + [(2, k, k + 1) for k in range(20)] + [(2, 7, 7), (2, 8, 9)]
    for k in range(400):
        edges.append((3, rng.randrange(500), rng.randrange(500)))
    rng.shuffle(edges)
    least = {}

    def root(n):
        while least.setdefault(n, n) != n:
            n = least[n]
        return n

    for p, a, b in edges:
        if a != b:
            one, two = sorted((root((p, a)), root((p, b))))
            least[two] = one
    df = spark.createDataFrame(edges, "page int, src long, dst long").repartition(5)
    got = {(r.page, r.node): r.component for r in contracted_components(df, ["page"]).collect()}
    assert got == {n: root(n)[1] for n in list(least)}
    assert contracted_components(df.limit(0), ["page"]).count() == 0


def test_groups_are_never_cut_by_batches():
    rows = [(k // 7 if k // 7 != 4 else None, k % 7 // 3, k) for k in range(200)] + [(99, 0, k) for k in range(60)]
    for size in (1, 2, 3, 7, 50, 1000):
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["a", "b", "c"]) for part in parts]
        out = [t.to_pylist() for t in bands.whole_groups(iter(batches), 2)]
        assert [tuple(r.values()) for t in out for r in t] == rows
        ends = [(t[0]["a"], t[0]["b"]) for t in out[1:]]
        assert all(end != (t[-1]["a"], t[-1]["b"]) for end, t in zip(ends, out))


def test_runs_are_the_stretches_of_each_pixel_row():
    rng = random.Random(8)
    drawn = [(p, b, y, x) for p in (None, 3, 4) for b in (0, 1) for y in range(6) for x in range(30) if rng.random() < 0.6]
    drawn = sorted(drawn + rng.sample(drawn, 40), key=lambda r: (r[0] is not None, *[v or 0 for v in r]))  # some pixels twice
    want, at = {}, {}
    for *row, x in drawn:
        at[tuple(row)] = at.get(tuple(row), 0) + 1
        want.setdefault((*row, x - at[tuple(row)]), []).append(x)
    table = pa.table([pa.array(c, pa.int64()) for c in zip(*drawn)], names=["page_id", "band", "y", "x"])
    for cut in (table, table.slice(57), table.slice(0, 1)):
        got = bands.runs(cut)
        assert got.schema.names == ["page_id", "band", "y", "xa", "xb"]
        if cut is table:
            assert sorted(map(repr, (tuple(r.values()) for r in got.to_pylist()))) == sorted(repr((*k[:3], xs[0], xs[-1])) for k, xs in want.items())
    assert bands.runs(table.slice(0, 1)).num_rows == 1


def test_pixels_of_a_band_are_held_by_one_sort_only(spark):
    """A window and an aggregation over a task's pixels would each take as much memory again."""

    df = spark.createDataFrame([(1, y, x) for y in range(5) for x in range(9)], INK)
    plan = I._band_parts(df, "page_id", 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Window" not in plan and "Aggregate" not in plan
    assert "REPARTITION_BY_NUM" in plan  # partitions are not put together by their compressed size


def test_stroke_pixels_come_once(spark, tmp_path):
    rows = [(k, (k * 7) % 50) for k in range(60)] + [(k, 24 * (k % 3) - 5) for k in range(40)]
    rows += rows[:30] + [(4, -23), (10, -17), (5, None), (None, 3), (None, 3), (None, None), (4, 24), (4, 48)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    ink = T.stroke_regions(spark, str(tmp_path))
    want = set()
    for key, size in rows:
        if size is None:
            continue
        w, shape = 10 + (abs(size) % 24) * (1 if size >= 0 else -1), None if key is None else key % 6
        for y in range(40):
            if 5 <= y < 9 and shape in (5, None):
                continue
            bulge = (y - 20) * (y - 20) * (w - 2) / 1240
            bulge = int(np.floor(bulge))
            a = {1: 0 if y < 6 else w - 2, 2: bulge, 3: w - 2 - bulge, 4: int(np.floor(w * (18 - y) / 36)) if y < 18 else w - 2}.get(shape, w // 2)
            b = a + 1
            if shape == 1 and y < 6:
                b = w - 1
            if shape == 4 and 18 <= y < 22:
                a, b = 0, w - 1
            spans = [(a, b)] + ([(w - 2, w - 1)] if shape == 4 and y < 18 else [])
            want |= {(key, w, 40, y, x) for lo, hi in spans for x in range(min(lo, hi), max(lo, hi) + 1)}
    got = [tuple(r) for r in ink.select("region_id", "width", "height", "y", "x").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = ink._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any("Aggregate(keys" in line and "y#" in line for line in plan.splitlines())


def test_blank_pages_have_no_components(spark):
    df = spark.createDataFrame([(1, 0, x) for x in range(19)], INK)
    assert I.component_boxes(df, min_pixels=1).count() == 0


def test_bright_page_is_inverted(spark):
    px = [(1, y, x, 0.0 if (y, x) == (2, 2) else 0.9, 5, 5) for y in range(5) for x in range(5)]
    px += [(2, y, x, 0.8 if (y, x) == (2, 2) else 0.05, 5, 5) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(px, "page_id int, y int, x int, v double, width int, height int")
    out = I.ink_only(I.normalize_ink(df)).orderBy("page_id").select("page_id", "y", "x", F.round("v", 3).alias("v")).collect()
    assert [tuple(r) for r in out] == [(1, 2, 2, 1.0), (2, 2, 2, 0.8)]


def test_stem_with_dot_and_two_dots(spark):
    def rect(rid, x0, y0, x1, y1):
        return [(rid, 60, 80, y, x) for y in range(y0, y1) for x in range(x0, x1)]

    ink = rect("i", 20, 30, 26, 70) + rect("i", 20, 10, 26, 18)
    ink += rect("!", 20, 5, 26, 50) + rect("!", 20, 60, 26, 67)
    ink += rect(":", 20, 10, 30, 20) + rect(":", 21, 40, 31, 50)
    ink += rect("one", 20, 5, 26, 70)
    df = spark.createDataFrame(ink, "region_id string, width int, height int, y int, x int")
    got = {r.region_id: r.punctuation for r in I.punctuation_labels(df).collect()}
    assert got == {"i": "i", "!": "!", ":": ":"}


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        result = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_stack_of_boxes_that_are_anchor_and_mark_takes_no_rounds(spark):
    """Every second box of a column takes the one below it; longer columns take no more jobs."""

    jobs = {}
    for n in (20, 200):
        data = {0: [(40, 30 * k, 60, 30 * k + 20) for k in range(n)]}
        boxes, pixels = frames(spark, data, {0: fill(data[0], 1)})
        got, jobs[n] = jobs_of(spark, f"stack{n}", lambda: as_sets(Y.attach_small_marks(Y.assign_rows(boxes), pixels)))
        assert got[0] == sorted((40, 60 * k, 60, 60 * k + 50) for k in range(n // 2))
    assert jobs[200] <= jobs[20] + 8


def test_marks_go_to_the_first_standing_box_in_reading_order(spark):
    rng = random.Random(31)
    data = {p: [] for p in range(40)}
    for p in data:
        for k in range(40):  # crowded boxes of about 20 by 20, nearly all anchor and mark
            x0, y0 = rng.randrange(0, 160), rng.randrange(0, 160)
            data[p].append((x0, y0, x0 + rng.randrange(14, 27), y0 + rng.randrange(14, 30)))
        data[p] = list(dict.fromkeys(data[p]))
    boxes, pixels = frames(spark, data, {p: fill(bs, 1) for p, bs in data.items()})
    ordered = Y.assign_rows(boxes)
    page_rows = {}
    for r in ordered.collect():
        page_rows.setdefault(r.page_id, []).append((r.row, r.place, (r.x0, r.y0, r.x1, r.y1)))
    wanted = {}
    for p, rows in page_rows.items():
        line = [b for _, _, b in sorted(rows)]
        area = {b: len(inside(fill(data[p], 1), b)) for b in line}
        limit = max(18.0, sorted(area.values())[len(line) // 2] * 0.35 if len(line) % 2 else sum(sorted(area.values())[len(line) // 2 - 1 : len(line) // 2 + 1]) / 2 * 0.35)
        owner = {}
        for a in line:
            w, h = a[2] - a[0], a[3] - a[1]
            if a in owner or not (area[a] > limit or (h >= 28 and h / w >= 3)):
                continue
            owner[a] = a
            for m in line:
                mw, mh = m[2] - m[0], m[3] - m[1]
                gx, gy = max(a[0] - m[2], m[0] - a[2], 0), max(a[1] - m[3], m[1] - a[3], 0)
                small = area[m] <= limit or min(mw, mh) <= 7 or (mw <= 24 and mh <= 24)
                near = abs(a[0] + a[2] - m[0] - m[2]) / 2 <= 0.75 * max(w, mw, 12) and (gx * gx + gy * gy) ** 0.5 <= 0.85 * max(h, mh, 14)
                if m not in owner and small and near:
                    owner[m] = a
        hulls = {}
        for m in line:
            o = hulls.get(owner.get(m, m), m)
            hulls[owner.get(m, m)] = (min(o[0], m[0]), min(o[1], m[1]), max(o[2], m[2]), max(o[3], m[3]))
        wanted[p] = sorted(hulls.values())
    assert as_sets(Y.attach_small_marks(ordered, pixels)) == wanted


def plain_absorbed(boxes):
    """One box after another, each taking what fits of those left, looked at one by one."""

    left, done = [tuple(map(int, b)) for b in boxes], []
    while left:
        a, rest = left[0], []
        for b in left[1:]:
            (w, h), (v, k) = (a[2] - a[0], a[3] - a[1]), (b[2] - b[0], b[3] - b[1])
            wide, high = max(a[2], b[2]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[1], b[1])
            over = (min(a[2], b[2]) - max(a[0], b[0])) / max(1, min(w, v))
            if b[1] - a[3] <= max(16, int(min(h, k) * 0.12)) and over >= 0.35 and min(a[4], b[4]) >= 45 and wide <= 1.25 * max(high, 1) and high <= 1.65 * max(h, k, 1):
                a = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]))
            else:
                rest.append(b)
        done.append(a)
        left = rest
    return done


def random_stack(rng, n, width, height):
    rows = []
    for _ in range(n):
        x0, y0 = rng.randrange(width), rng.randrange(height)
        rows.append((x0, y0, x0 + rng.randrange(4, 40), y0 + rng.randrange(4, 60), rng.choice((20, 45, 100, 700))))
    return sorted(rows, key=lambda b: (b[1], b[0], b[2], b[3], b[4]))


def test_sweep_equals_one_by_one():
    rng = random.Random(17)
    for n in (1, 2, 3, 10, 60, 200):
        for _ in range(12):
            rows = random_stack(rng, n, rng.choice((5, 60, 300)), rng.choice((10, 200, 2000)))
            got = sweeps.absorbed(np.array(rows, np.int64), Y._fit_stacked, Y._below_stack)
            assert [tuple(b) for b in got.tolist()] == plain_absorbed(rows)


def test_five_thousand_overlapping_boxes_on_one_page(spark):
    rng = random.Random(23)
    rows = random_stack(rng, 5000, 200, 900)
    df = spark.createDataFrame([(1, *b) for b in rows] + [(2, 0, 0, 9, 9, 50)], "page_id int, x0 int, y0 int, x1 int, y1 int, area long").repartition(4)
    got = Y.merge_stacked_parts(df).collect()
    once = sweeps.absorbed(np.array(rows, np.int64), Y._fit_stacked, Y._below_stack)
    assert sorted(tuple(r)[1:] for r in got if r.page_id == 1) == sorted(map(tuple, once.tolist())) and len(got) == len(once) + 1


def test_column_bits_answer_boxes_like_pixels(spark):
    rng = random.Random(29)
    ink = {(rng.randrange(300), rng.randrange(200)) for _ in range(9000)} | {(y, 5) for y in range(300)} | {(63, x) for x in range(200)} | {(64, 70)}
    rects = []
    for _ in range(80):
        x0, y0 = rng.randrange(190), rng.randrange(290)
        rects.append((x0, y0, x0 + rng.randrange(1, 120), y0 + rng.randrange(1, 200)))
    rects += [(5, 0, 6, 64), (5, 64, 6, 128), (5, 63, 6, 65), (0, 63, 200, 64), (250, 0, 260, 10)]
    boxes, pixels = frames(spark, {0: rects}, {0: ink})
    index = I.ink_columns(pixels)
    assert index.count() < len(ink) / 3
    got = {r.box_id: (r.n, r.x0, r.y0, r.x1, r.y1) for r in I.ink_bounds(boxes, index, "page_id", ["page_id", "box_id"]).collect()}
    areas = {r.box_id: r.area for r in I.box_ink_area(boxes, index, "box_id").collect()}
    for k, b in enumerate(rects):
        own = inside(ink, b)
        assert areas[k] == len(own) and got.get(k) == ((len(own), *bounds(own)) if own else None)


def test_cuts_by_bits_equal_cuts_by_sums(spark):
    rng = random.Random(37)
    ink = {(y, x) for y in range(150) for x in range(260) if rng.random() < 0.2 + 0.3 * ((x // 13) % 2)}
    windows = []
    for k in range(60):
        lo, y0 = rng.randrange(-6, 250), rng.randrange(0, 120)
        windows.append((0, k, 260, lo, lo + rng.choice((1, 2, 3, 5, 6, 7, 8, 40, 90)), y0, y0 + rng.randrange(1, 80)))
    frame = spark.createDataFrame(windows, "page_id int, box_id int, width int, lo int, hi int, y0 int, y1 int")
    pixels = spark.createDataFrame([(0, y, x) for y, x in ink], INK)
    got = {r.box_id: r.cut for r in Y.best_cuts(frame, I.ink_columns(pixels), ["box_id"]).collect()}
    for _, k, width, lo, hi, y0, y1 in windows:
        lo, hi = max(0, lo), min(width - 1, hi)
        sums = [sum((y, x) in ink for y in range(y0, y1)) for x in range(lo, hi)]
        if hi <= lo + 2:
            assert got[k] == (lo + hi) // 2
            continue
        even = [sum(sums[max(0, i - 3) : i + 4]) / 7 for i in range(len(sums))] if len(sums) >= 7 else sums
        assert got[k] == lo + min((abs(i - len(sums) / 2), i) for i, v in enumerate(even) if v <= min(even) + 0.5)[1]


def test_exploded_tables_never_go_through_the_driver(spark):
    boxes, pixels = frames(spark, {0: [(0, 0, 90, 40), (100, 0, 200, 40)], 1: [(3, 3, 70, 30)]}, {0: {(y, x) for y in range(40) for x in range(0, 200, 3)}, 1: {(5, 9)}})
    index = I.ink_columns(pixels)
    windows = boxes.selectExpr("page_id", "box_id", "300 as width", "x0 as lo", "x1 as hi", "y0", "y1")
    glyphs = spark.createDataFrame([(0, 1, 1, "a"), (0, 2, 2, "b"), (1, 1, 1, "c")], "page_id int, row int, idx int, shown string")
    cleaned = spark.createDataFrame([(0, ["a"]), (1, ["c"])], "page_id int, rows array<string>")
    plans = [
        I.ink_in_boxes(boxes, pixels), I.ink_bounds(boxes, index, "page_id", ["page_id", "box_id"]), I.box_ink_area(boxes, index, "box_id"),
        Y.best_cuts(windows, index, ["box_id"]), Y.assign_rows(boxes), visible_predictions(glyphs, cleaned),
    ]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.page_id, r.row) for r in plans[-1].collect()} == {(0, 1), (1, 1)}


def test_components_of_tiles_equal_those_of_pixels(spark):
    rng = random.Random(21)
    drawn = {(p, rng.randrange(0, 200), rng.randrange(0, 140)) for p in range(5) for _ in range(900)}
    drawn |= {(7, y, 64) for y in range(64, 128)} | {(8, 63, x) for x in range(60, 70)} | {(8, 65, x) for x in range(69, 75)}
    df = spark.createDataFrame(sorted(drawn), "page_id int, y int, x int").repartition(5)
    for grow in (0, 1, 2):
        options = {"min_pixels": 2, "dilation": grow, "min_page_ink": 0, "min_box_area": 0}
        want = I.component_boxes(df, **options)
        got = I.component_boxes(df, **options, columns=I.ink_columns(df))
        assert got.schema == want.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_regions_are_split_by_tiles_of_the_page_as_by_their_own_pixels(spark):
    rng = random.Random(4)
    boxes, pixels = {}, set()
    for p in range(12):
        x0, y0, w, h = rng.randrange(0, 90), rng.randrange(0, 90), rng.randrange(50, 240), rng.randrange(30, 90)
        cut = rng.randrange(w // 3, 2 * w // 3)
        pixels |= {(p, y0 + y, x0 + x) for x in range(w) if abs(x - cut) > 6 for y in range(rng.randrange(h // 2, h))}
        pixels |= {(p, y0 + h, x0), (p, y0, x0 + w)}  # beside the region
        boxes[p] = (f"r{p}", p, x0, y0, x0 + w, y0 + h)
    keyed = spark.createDataFrame(list(boxes.values()), "region_id string, page_id int, x0 int, y0 int, x1 int, y1 int")
    ink = spark.createDataFrame(sorted(pixels), "page_id int, y int, x int")
    sized = keyed.selectExpr("region_id", "page_id", "x0", "y0", "x1 - x0 AS width", "y1 - y0 AS height")
    local = I.ink_in_boxes(keyed, ink, "page_id", ["region_id", "x0", "y0"]).selectExpr("region_id", "y - y0 AS y", "x - x0 AS x")
    want = Y.split_touching(sized, local)
    got = Y.split_by_tiles(sized, I.tiles_in_boxes(keyed, I.ink_columns(ink), "page_id", ["region_id"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > len(boxes)


def test_no_pixel_of_a_dealt_page_is_shuffled_or_written(spark, tmp_path, monkeypatch):
    spark.range(200).selectExpr("id AS p_partkey", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    ink = T.scattered_ink(spark, str(tmp_path))
    for df in (ink, I.ink_columns(ink), I.held_columns(I.ink_columns(ink))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
    written = []
    for module in (page_layout, I, Y):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: written.append(df.columns) or cut(df))
    assert character_regions(spark, str(tmp_path)).count() > 100
    assert len(written) > 5 and not any("y" in columns or "bits" in columns for columns in written)
