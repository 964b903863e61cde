"""Queries on ink: polarity, components, shapes and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.operators import ink as I
from glyphloom.operators import layout as Y
from glyphloom.plans import page_layout
from glyphloom.plans import standins as T
from glyphloom.plans.registry import query, rounded
from glyphloom.plans.standins import recursive, with_ctes
from glyphloom.session import by_shuffle


@query(
    "p14_ink_normalization",
    with_ctes(
        ["pixels"],
        """, b AS (SELECT page_id, median(v) > 0.5 AS bright FROM (SELECT page_id, v FROM pixels WHERE y = 0 UNION ALL SELECT page_id, v FROM pixels WHERE y = 7
          UNION ALL SELECT page_id, v FROM pixels WHERE x = 0 UNION ALL SELECT page_id, v FROM pixels WHERE x = 7) GROUP BY 1),
        n AS (SELECT page_id, y, x, CASE WHEN bright THEN 1.0::DOUBLE - v ELSE v END AS v FROM pixels JOIN b USING (page_id))
        SELECT page_id, y, x, round(((CASE WHEN v < 0.18 THEN 0.0 ELSE v END) - 0.1307::DOUBLE) / 0.3081::DOUBLE, 6) AS v FROM n""",
    ).replace("\n, b AS", ",\nb AS"),
)
def ink_normalization(spark: SparkSession, root: str) -> DataFrame:
    normal = I.normalize_ink(T.grid_pixels(spark, root))
    return normal.select("page_id", "y", "x", rounded(I.standardize(F.col("v"))).alias("v"))


@query("p15_axis_fix", with_ctes(["pixels"], "SELECT page_id, x AS y, y AS x, round(v, 6) AS v FROM pixels"))
def axis_fix(spark: SparkSession, root: str) -> DataFrame:
    return I.transpose(T.grid_pixels(spark, root)).select("page_id", "y", "x", rounded("v").alias("v"))


@query(
    "a18_component_boxes",
    with_ctes(
        ["word_boxes"],
        """SELECT page_id, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, pixels FROM word_boxes
        WHERE pixels >= 12 AND (x1 - x0) * (y1 - y0) >= 20 AND page_id IN (SELECT page_id FROM word_ink GROUP BY 1 HAVING count(*) >= 20)""",
    ),
)
def component_boxes(spark: SparkSession, root: str) -> DataFrame:
    return I.component_boxes(T.word_ink(spark, root)).select("page_id", "x0", "y0", "x1", "y1", "pixels")


def _span(band: str) -> str:
    return f"coalesce((max(CASE WHEN {band} THEN x END) - min(CASE WHEN {band} THEN x END) + 1) / width::DOUBLE, 0.0)"


# Band edges of a region 40 pixels high.
_FEATURES = f"""SELECT region_id, width, width / 40.0::DOUBLE AS aspect, count(*) / (width * 40)::DOUBLE AS density,
    {_span('y < 10')} AS top_span, {_span('y >= 22')} AS low_span, {_span('y >= 14 AND y < 26')} AS middle_span,
    {_span('y >= 16 AND y < 24')} AS bar_span, {_span('y >= 30')} AS bottom_span,
    count(DISTINCT CASE WHEN x >= floor(width * 0.58::DOUBLE) THEN y END) / 40.0::DOUBLE AS right_coverage,
    count(*) FILTER (y >= 24 AND x < greatest(1, floor(width * 0.38::DOUBLE))) / (16 * greatest(1, floor(width * 0.38::DOUBLE)))::DOUBLE AS lower_left,
    count(*) FILTER (y < 18 AND x < greatest(1, floor(width * 0.45::DOUBLE))) / (18 * greatest(1, floor(width * 0.45::DOUBLE)))::DOUBLE AS top_left,
    {', '.join(f'sum(x) FILTER (y >= {8 * i} AND y < {8 * i + 8}) / (count(*) FILTER (y >= {8 * i} AND y < {8 * i + 8}))::DOUBLE / width AS center{i}' for i in range(5))},
    min(x) AS tight_x0, max(x) + 1 AS tight_x1, min(y) AS tight_y0, max(y) + 1 AS tight_y1 FROM strokes GROUP BY region_id, width"""

_FEATURE_COLUMNS = [
    "aspect", "density", "top_span", "low_span", "middle_span", "bar_span", "bottom_span", "right_coverage",
    "lower_left", "top_left", *[f"center{i}" for i in range(5)],
]


@query(
    "a19_shape_features",
    with_ctes(
        ["strokes"],
        f"SELECT region_id, {', '.join(f'round({c}, 6) AS {c}' for c in _FEATURE_COLUMNS)}, CAST(tight_x0 AS INTEGER) AS tight_x0, CAST(tight_x1 AS INTEGER) AS tight_x1 FROM ({_FEATURES})",
    ),
)
def shape_features(spark: SparkSession, root: str) -> DataFrame:
    out = I.shape_features(T.stroke_regions(spark, root))
    return out.select("region_id", *[rounded(c).alias(c) for c in _FEATURE_COLUMNS], "tight_x0", "tight_x1")


@query(
    "a20_shape_labels",
    with_ctes(
        ["strokes"],
        f""", f AS ({_FEATURES})
        SELECT region_id, coalesce(aspect BETWEEN 0.24 AND 0.62 AND top_span >= 0.48 AND low_span <= 0.22, false) AS like_seven,
        coalesce(aspect <= 0.34 AND top_span <= 0.22 AND low_span <= 0.24, false) AS like_one,
        coalesce(aspect BETWEEN 0.35 AND 0.85 AND bar_span >= 0.45 AND right_coverage >= 0.55 AND lower_left <= 0.10 AND top_left >= 0.015, false) AS like_four,
        CASE WHEN aspect BETWEEN 0.32 AND 0.72 AND density <= 0.08 AND middle_span <= 0.36 AND bottom_span <= 0.38 THEN
          CASE WHEN center2 <= center0 - 0.15::DOUBLE AND center2 <= center4 - 0.10::DOUBLE THEN '('
            WHEN top_span <= 0.58 AND center2 >= center0 + 0.15::DOUBLE AND center2 >= center4 + 0.10::DOUBLE THEN ')' END END AS parenthesis FROM f""",
    ).replace("\n, f AS", ",\nf AS"),
)
def shape_labels(spark: SparkSession, root: str) -> DataFrame:
    out = I.shape_flags(I.shape_features(T.stroke_regions(spark, root)))
    return out.select("region_id", "like_seven", "like_one", "like_four", "parenthesis")


@query(
    "a20_punctuation_labels",
    with_ctes(
        ["strokes"],
        f""", f AS ({_FEATURES}), p AS (SELECT region_id, CASE WHEN aspect BETWEEN 0.32 AND 0.72 AND density <= 0.08 AND middle_span <= 0.36 AND bottom_span <= 0.38 THEN
          CASE WHEN center2 <= center0 - 0.15::DOUBLE AND center2 <= center4 - 0.10::DOUBLE THEN '('
            WHEN top_span <= 0.58 AND center2 >= center0 + 0.15::DOUBLE AND center2 >= center4 + 0.10::DOUBLE THEN ')' END END AS paren FROM f)
        SELECT region_id, coalesce(paren, 'i') AS punctuation FROM p WHERE paren IS NOT NULL OR region_id % 6 = 5""",
    ).replace("\n, f AS", ",\nf AS"),
)
def punctuation_labels(spark: SparkSession, root: str) -> DataFrame:
    return I.punctuation_labels(T.stroke_regions(spark, root))


# ------------------------------------------------------------------ layout


@query(
    "v01_reading_order",
    with_ctes(
        ["word_boxes"],
        """SELECT page_id, box_id, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY line) AS INTEGER) AS row,
        CAST(row_number() OVER (PARTITION BY page_id, line ORDER BY x0) AS INTEGER) AS place FROM word_boxes""",
    ),
)
def reading_order(spark: SparkSession, root: str) -> DataFrame:
    return Y.assign_rows(T.word_boxes(spark, root)).select("page_id", "box_id", "row", "place")


@query(
    "v02_padded_boxes",
    with_ctes(
        ["word_boxes"],
        """SELECT page_id, box_id, CAST(greatest(coalesce(lag(x1) OVER w, 0), x0 - pad) AS INTEGER) AS px0, CAST(greatest(0, y0 - pad) AS INTEGER) AS py0,
        CAST(least(coalesce(lead(x0) OVER w, width), x1 + pad) AS INTEGER) AS px1, CAST(least(height, y1 + pad) AS INTEGER) AS py1
        FROM (SELECT *, greatest(4, floor(greatest(x1 - x0, y1 - y0) * 0.15::DOUBLE)) AS pad FROM word_boxes)
        WINDOW w AS (PARTITION BY page_id, line ORDER BY x0)""",
    ),
)
def padded_boxes(spark: SparkSession, root: str) -> DataFrame:
    padded = Y.padded_boxes(Y.assign_rows(T.word_boxes(spark, root)))
    return padded.select("page_id", "box_id", "px0", "py0", "px1", "py1")


@query(
    "v03_best_vertical_cut",
    with_ctes(
        ["word_boxes"],
        """, b AS (SELECT page_id, box_id, line, greatest(0, x0 - 2) AS lo, least(width - 1, x1 + 2) AS hi, y0, y1 FROM word_boxes),
        c AS (SELECT page_id, line, x, count(*) AS n FROM word_ink GROUP BY 1, 2, 3),
        d AS (SELECT b.page_id, b.box_id, lo, hi, xs.x, coalesce(c.n, 0) AS n FROM (SELECT *, unnest(range(lo, hi)) AS x FROM b) xs
          JOIN b USING (page_id, box_id, lo, hi) LEFT JOIN c ON c.page_id = xs.page_id AND c.line = xs.line AND c.x = xs.x),
        p AS (SELECT *, CASE WHEN hi - lo >= 7 THEN sum(n) OVER (PARTITION BY page_id, box_id ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0::DOUBLE ELSE n END AS p FROM d),
        m AS (SELECT *, min(p) OVER (PARTITION BY page_id, box_id) AS mn FROM p)
        SELECT page_id, box_id, CAST(x AS INTEGER) AS cut FROM m WHERE p <= mn + 0.5
        QUALIFY row_number() OVER (PARTITION BY page_id, box_id ORDER BY abs(x - lo - (hi - lo) / 2.0::DOUBLE), x) = 1""",
    ).replace("\n, b AS", ",\nb AS"),
)
def best_vertical_cut(spark: SparkSession, root: str) -> DataFrame:
    boxes = T.word_boxes(spark, root)
    windows = boxes.select(
        "page_id", "box_id", "width", "y0", "y1", (F.col("x0") - 2).alias("lo"), (F.col("x1") + 2).alias("hi")
    )
    return Y.best_cuts(windows, I.ink_columns(T.word_ink(spark, root)), ["box_id"]).select("page_id", "box_id", "cut")


def banner_boxes(spark: SparkSession, root: str) -> DataFrame:
    return T.banner_ink(spark, root).groupBy("page_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")
    ).withColumns({"box_id": F.col("page_id"), "width": F.lit(400), "height": F.lit(64)})


# A banner has one stroke per column from y = 4 down, so columns with heights say it all.
@query(
    "v04_wide_box_split",
    with_ctes(
        ["banner_columns"],
        """, b AS (SELECT page_id, min(x) AS x0, max(x) + 1 AS x1, max(n) AS h FROM banner_columns GROUP BY 1),
        s AS (SELECT *, x1 - x0 AS w, CASE WHEN h > 20 AND (x1 - x0) / h::DOUBLE >= 1.45
          THEN least(4, greatest(1, CAST(round_even((x1 - x0) / (h * 0.62::DOUBLE), 0) AS INTEGER))) ELSE 1 END AS pieces FROM b),
        k AS (SELECT *, x0 + floor(w * part / pieces::DOUBLE) AS e, greatest(12, floor(w / pieces::DOUBLE * 0.35)) AS r FROM s, range(1, 4) p(part) WHERE part < pieces),
        d AS (SELECT k.page_id, part, e - r AS lo, e + r AS hi, x, n FROM k JOIN banner_columns c ON c.page_id = k.page_id AND x >= e - r AND x < e + r),
        m AS (SELECT *, sum(n) OVER (PARTITION BY page_id, part ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0::DOUBLE AS p FROM d),
        q AS (SELECT *, min(p) OVER (PARTITION BY page_id, part) AS mn FROM m),
        c AS (SELECT page_id, part, x FROM q WHERE p <= mn + 0.5 QUALIFY row_number() OVER (PARTITION BY page_id, part ORDER BY abs(x - lo - (hi - lo) / 2), x) = 1),
        v AS (SELECT s.page_id, x0, x1, max(CASE WHEN part = 1 THEN x END) AS c1, max(CASE WHEN part = 2 THEN x END) AS c2, max(CASE WHEN part = 3 THEN x END) AS c3
          FROM s LEFT JOIN c USING (page_id) GROUP BY 1, 2, 3),
        g1 AS (SELECT *, CASE WHEN c1 - x0 > 8 AND x1 - c1 > 8 THEN c1 END AS e1 FROM v),
        g2 AS (SELECT *, CASE WHEN c2 - coalesce(e1, x0) > 8 AND x1 - c2 > 8 THEN c2 END AS e2 FROM g1),
        g3 AS (SELECT *, CASE WHEN c3 - coalesce(e2, e1, x0) > 8 AND x1 - c3 > 8 THEN c3 END AS e3 FROM g2),
        l AS (SELECT page_id, list_filter([x0, e1, e2, e3, x1], lambda z: z IS NOT NULL) AS edges FROM g3),
        t AS (SELECT page_id, edges[i] AS a, edges[i + 1] AS z, i FROM l, range(1, 5) r(i) WHERE i < len(edges))
        SELECT t.page_id, t.page_id AS box_id, CAST(i - 1 AS INTEGER) AS piece, CAST(min(x) AS INTEGER) AS x0, 4 AS y0, CAST(max(x) + 1 AS INTEGER) AS x1, CAST(4 + max(n) AS INTEGER) AS y1
        FROM t JOIN banner_columns k ON k.page_id = t.page_id AND x >= a AND x < z GROUP BY t.page_id, i HAVING sum(n) >= 12""",
    ).replace("\n, b AS", ",\nb AS"),
)
def wide_box_split(spark: SparkSession, root: str) -> DataFrame:
    out = Y.split_wide_boxes(banner_boxes(spark, root), T.banner_ink(spark, root))
    return out.select("page_id", "box_id", "piece", "x0", "y0", "x1", "y1")


# Neighbours in x order are walked one by one; each step knows where the last box now starts.
@query(
    "v04_overlap_trim",
    with_ctes(
        ["scattered"],
        """, px AS (SELECT DISTINCT page_id, y, x FROM (SELECT page_id, x0, x1, unnest(range(y0, y1, 2)) AS y FROM scattered) b, range(0, 400) r(x) WHERE x >= x0 AND x < x1),
        col AS (SELECT page_id, x, count(*) AS n FROM px GROUP BY 1, 2),
        s AS (SELECT page_id, box_id, x0, y0, x1, y1, row_number() OVER v AS seq, lag(x1) OVER v AS prev FROM (SELECT * REPLACE (x1 + 12 AS x1) FROM scattered)
          WINDOW v AS (PARTITION BY page_id ORDER BY x0, y0, x1, y1)),
        pr AS (SELECT page_id, seq, greatest(0, x0) AS lo, least(399, prev) AS hi FROM s WHERE prev > x0),
        d AS (SELECT q.page_id, q.seq, lo, hi, q.x, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(lo, hi)) AS x FROM pr WHERE hi > lo + 2) q
          LEFT JOIN col ON col.page_id = q.page_id AND col.x = q.x),
        m AS (SELECT *, CASE WHEN hi - lo >= 7 THEN sum(n) OVER (PARTITION BY page_id, seq ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0::DOUBLE ELSE n END AS p FROM d),
        mn AS (SELECT *, min(p) OVER (PARTITION BY page_id, seq) AS least_p FROM m),
        cuts AS (SELECT page_id, seq, x AS cut FROM mn WHERE p <= least_p + 0.5
            QUALIFY row_number() OVER (PARTITION BY page_id, seq ORDER BY abs(x - lo - (hi - lo) / 2.0::DOUBLE), x) = 1
          UNION ALL SELECT page_id, seq, (lo + hi) // 2 FROM pr WHERE hi <= lo + 2),
        b AS (SELECT s.*, cut FROM s LEFT JOIN cuts USING (page_id, seq)),
        rec AS (SELECT page_id, seq, x0, x1, NULL::BIGINT AS before_x1 FROM b WHERE seq = 1
          UNION ALL SELECT page_id, seq, CASE WHEN moves THEN c ELSE nx0 END, nx1, CASE WHEN moves THEN c ELSE x1 END FROM (
            SELECT *, coalesce(x1 > nx0 AND share >= 0.12 AND c - x0 >= greatest(8, floor((x1 - x0 + nx1 - nx0) / 2.0::DOUBLE * 0.18::DOUBLE))
              AND nx1 - c >= greatest(8, floor((x1 - x0 + nx1 - nx0) / 2.0::DOUBLE * 0.18::DOUBLE)), false) AS moves FROM (
            SELECT *, CASE WHEN share >= 0.35 THEN least(cut, nx0 + CAST(floor((x1 - nx0) * 0.35::DOUBLE) AS BIGINT)) ELSE cut END AS c FROM (
            SELECT b.page_id, b.seq, rec.x0, rec.x1, b.x0 AS nx0, b.x1 AS nx1, b.cut,
              (rec.x1 - b.x0) / greatest(1, least(rec.x1 - rec.x0, b.x1 - b.x0))::DOUBLE AS share
            FROM rec JOIN b ON b.page_id = rec.page_id AND b.seq = rec.seq + 1)))),
        f AS (SELECT rec.page_id, rec.seq, rec.x0, coalesce(nxt.before_x1, rec.x1) AS x1 FROM rec LEFT JOIN rec nxt ON nxt.page_id = rec.page_id AND nxt.seq = rec.seq + 1)
        SELECT f.page_id, b.box_id, CAST(f.x0 AS INTEGER) AS x0, b.y0, CAST(f.x1 AS INTEGER) AS x1, b.y1 FROM f JOIN b USING (page_id, seq) WHERE f.x1 > f.x0 AND b.y1 > b.y0""",
    ).replace("\n, px AS", ",\npx AS").replace("WITH ", "WITH RECURSIVE ", 1),
)
def overlap_trim(spark: SparkSession, root: str) -> DataFrame:
    boxes = T.scattered_boxes(spark, root).withColumns({"width": F.lit(400), "height": F.lit(200)})
    wider = boxes.withColumn("x1", F.col("x1") + 12)
    return Y.trim_overlaps(wider, T.scattered_ink(spark, root)).select("page_id", "box_id", "x0", "y0", "x1", "y1")


def _touching_level(k: int) -> str:
    """One round on stretches of banner columns: a stretch keeps its ink from the top row down, so column heights say it all."""

    region = "PARTITION BY page_id, id"
    return f""", col{k} AS (SELECT * FROM (SELECT r.page_id, id, a, b, b - a AS w, c.x - a AS x, n, max(n) OVER ({region}) AS h,
          sum(n) OVER ({region} ORDER BY c.x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0::DOUBLE AS s
          FROM reg{k} r JOIN (SELECT page_id AS page, x, n FROM banner_columns) c ON c.page = r.page_id AND c.x >= a AND c.x < b) WHERE w >= 48 AND w / greatest(h, 1)::DOUBLE >= 0.85),
        low{k} AS (SELECT page_id, id, x, x - row_number() OVER ({region} ORDER BY x) AS island FROM (SELECT *, max(s) OVER ({region}) AS peak FROM col{k})
          WHERE x >= floor(w * 0.30::DOUBLE) AND x < floor(w * 0.72::DOUBLE) AND s <= greatest(1.0, peak * 0.08::DOUBLE)),
        seam{k} AS (SELECT page_id, id, CAST(round_even((lo + hi) / 2.0::DOUBLE, 0) AS INTEGER) AS cut FROM (SELECT page_id, id, min(x) AS lo, max(x) AS hi FROM low{k} GROUP BY page_id, id, island)
          QUALIFY row_number() OVER ({region} ORDER BY hi - lo DESC, lo) = 1 AND hi - lo >= 4),
        val{k} AS (SELECT c.page_id, c.id, min(s) AS valley, arg_min(x, (s, x)) AS cut FROM col{k} c ANTI JOIN seam{k} USING (page_id, id)
          WHERE w >= 110 AND w / h::DOUBLE >= 1.15 AND x >= floor(w * 0.28::DOUBLE) AND x < floor(w * 0.74::DOUBLE) GROUP BY 1, 2),
        brd{k} AS (SELECT page_id, id, any_value(cut) AS cut FROM (SELECT c.*, valley, cut FROM col{k} c JOIN val{k} USING (page_id, id)) GROUP BY 1, 2
          HAVING least(coalesce(max(s) FILTER (x >= greatest(0, cut - 28) AND x < greatest(0, cut - 4)), 0), coalesce(max(s) FILTER (x >= cut + 5 AND x < cut + 29), 0)) > 0
          AND any_value(valley) <= greatest(2.5, 0.34::DOUBLE * least(max(s) FILTER (x >= greatest(0, cut - 28) AND x < greatest(0, cut - 4)), max(s) FILTER (x >= cut + 5 AND x < cut + 29)))
          AND sum(n) FILTER (x >= cut - 2 AND x < cut + 3) <= greatest(10, floor(any_value(h) * 0.22::DOUBLE))
          AND bool_and(cut >= 24 OR cut >= 8) AND max(n) FILTER (x < cut) >= CASE WHEN any_value(cut) >= 24 THEN 0 ELSE any_value(h) * 0.45::DOUBLE END
          AND any_value(w - cut) >= 8 AND max(n) FILTER (x >= cut) >= CASE WHEN any_value(w - cut) >= 24 THEN 0 ELSE any_value(h) * 0.45::DOUBLE END),
        cut{k} AS (SELECT c.page_id, c.id, any_value(a) AS a, any_value(b) AS b, any_value(cut) AS cut FROM col{k} c JOIN (SELECT * FROM seam{k} UNION ALL SELECT * FROM brd{k}) USING (page_id, id)
          GROUP BY 1, 2 HAVING sum(n) FILTER (x < cut) >= 20 AND sum(n) FILTER (x >= cut) >= 20),
        fin{k} AS (SELECT * FROM reg{k} ANTI JOIN cut{k} USING (page_id, id)),
        reg{k + 1} AS (SELECT page_id, id || '/0' AS id, a, a + cut AS b FROM cut{k} UNION ALL SELECT page_id, id || '/1', a + cut, b FROM cut{k})"""


@query(
    "v05_touching_split",
    with_ctes(
        ["banner_columns"],
        """, reg0 AS (SELECT page_id, CAST(page_id AS VARCHAR) AS id, min(x) AS a, max(x) + 1 AS b FROM banner_columns GROUP BY 1)"""
        + "".join(_touching_level(k) for k in range(3))
        + """, every AS (SELECT * FROM fin0 UNION ALL SELECT * FROM fin1 UNION ALL SELECT * FROM fin2 UNION ALL SELECT * FROM reg3)
        SELECT e.id AS region_id, CAST(a AS INTEGER) AS x0, 4 AS y0, CAST(b - a AS INTEGER) AS width, CAST(max(n) AS INTEGER) AS height
        FROM every e JOIN banner_columns c ON c.page_id = e.page_id AND c.x >= a AND c.x < b GROUP BY e.id, a, b""",
    ).replace("\n, reg0 AS", ",\nreg0 AS"),
)
def touching_split(spark: SparkSession, root: str) -> DataFrame:
    regions = banner_boxes(spark, root).select(
        F.col("page_id").cast("string").alias("region_id"), "x0", "y0",
        (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"),
    )
    ink = T.banner_ink(spark, root).withColumn("region_id", F.col("page_id").cast("string")).join(
        by_shuffle(regions.select("region_id", "x0", "y0")), "region_id"
    )
    local = ink.select("region_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"))
    return Y.split_touching(regions, local)


@query(
    "v01_reading_order_scattered",
    recursive(with_ctes(["scattered_rows"], "SELECT page_id, box_id, row, place FROM scattered_rows")),
)
def reading_order_scattered(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose running means decide where the next box goes."""

    return Y.assign_rows(T.scattered_boxes(spark, root)).select("page_id", "box_id", "row", "place")


# Boxes are walked in reading order; ``own`` holds for each box of the page the place of the box that has it, or 0.
@query(
    "j07_small_mark_attachment",
    recursive(
        with_ctes(
            ["scattered_sized"],
            """, z AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY row, place) AS k, x1 - x0 AS w, y1 - y0 AS h,
              greatest(18.0::DOUBLE, median(area) OVER (PARTITION BY page_id) * 0.35::DOUBLE) AS small FROM scattered_sized),
            b AS (SELECT *, area > small OR (h >= 28 AND h / greatest(w, 1)::DOUBLE >= 3.0) AS anchor,
              area <= small OR least(w, h) <= 7 OR (w <= 24 AND h <= 24) AS mark, (x0 + x1) / 2.0::DOUBLE AS c FROM z),
            near AS (SELECT a.page_id, a.k, list(m.k) AS takes FROM b a JOIN b m ON m.page_id = a.page_id AND m.k <> a.k AND a.anchor AND m.mark
              AND abs(a.c - m.c) <= greatest(a.w, m.w, 12) * 0.75::DOUBLE
              AND sqrt(pow(greatest(a.x0 - m.x1, m.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - m.y1, m.y0 - a.y1, 0), 2)) <= greatest(a.h, m.h, 14) * 0.85::DOUBLE
              GROUP BY 1, 2),
            walk AS (SELECT page_id, 0 AS step, list_transform(range(0, count(*)), lambda i: 0) AS own FROM b GROUP BY 1
              UNION ALL SELECT walk.page_id, step + 1, CASE WHEN own[step + 1] = 0 AND b.anchor THEN
                list_transform(own, lambda o, j: CASE WHEN o = 0 AND (j = step + 1 OR list_contains(coalesce(takes, []), j)) THEN step + 1 ELSE o END) ELSE own END
              FROM walk JOIN b ON b.page_id = walk.page_id AND b.k = step + 1 LEFT JOIN near ON near.page_id = walk.page_id AND near.k = step + 1),
            e AS (SELECT page_id, unnest(own) AS o, generate_subscripts(own, 1) AS k FROM walk QUALIFY step = max(step) OVER (PARTITION BY page_id))
            SELECT e.page_id, any_value(a.box_id) AS box_id, min(m.x0) AS x0, min(m.y0) AS y0, max(m.x1) AS x1, max(m.y1) AS y1
            FROM e JOIN b m ON m.page_id = e.page_id AND m.k = e.k JOIN b a ON a.page_id = e.page_id AND a.k = CASE WHEN o = 0 THEN e.k ELSE o END
            GROUP BY e.page_id, a.k""",
        ).replace("\n, z AS", ",\nz AS")
    ),
)
def small_mark_attachment(spark: SparkSession, root: str) -> DataFrame:
    ordered = Y.assign_rows(T.scattered_boxes(spark, root))
    return Y.attach_small_marks(ordered, T.scattered_ink(spark, root))


_UNION = """{'x0': least(c.x0, n.x0), 'y0': least(c.y0, n.y0), 'x1': greatest(c.x1, n.x1), 'y1': greatest(c.y1, n.y1), 'area': greatest(c.area, n.area)}"""
_BOX_TYPE = "STRUCT(x0 INTEGER, y0 INTEGER, x1 INTEGER, y1 INTEGER, area BIGINT)"
_MERGED = """(greatest(c.x1, n.x1) - least(c.x0, n.x0)) / greatest(1, greatest(c.y1, n.y1) - least(c.y0, n.y0))::DOUBLE <= 1.25 AND c.area >= 45 AND n.area >= 45"""
_H_SHARE = "(least(c.x1, n.x1) - greatest(c.x0, n.x0)) / greatest(1, least(c.x1 - c.x0, n.x1 - n.x0))::DOUBLE >= 0.35"


# Parts of a row are walked from left to right, comparing with the last box only; then a page's boxes from top to
# bottom: ``cur`` meets each of ``todo`` once, ``kept`` waits for the next ``cur``.
@query(
    "j08_broken_part_merge",
    recursive(
        with_ctes(
            ["scattered_sized"],
            f""", line AS (SELECT page_id, row, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area}}::{_BOX_TYPE} ORDER BY x0, y0, x1, y1, area) AS bs FROM scattered_sized GROUP BY 1, 2),
            walk AS (SELECT page_id, row, 1 AS step, [bs[1]] AS done FROM line
              UNION ALL SELECT page_id, row, step + 1, CASE WHEN joins THEN list_append(done[:-2], {_UNION}::{_BOX_TYPE}) ELSE list_append(done, n) END FROM (
                SELECT *, {_MERGED} AND (
                  (n.x0 - c.x1 >= 0 AND n.x0 - c.x1 <= greatest(10, floor(least(c.x1 - c.x0, n.x1 - n.x0) * 0.4::DOUBLE), floor(least(c.y1 - c.y0, n.y1 - n.y0) * 0.28::DOUBLE))
                    AND (least(c.y1, n.y1) - greatest(c.y0, n.y0)) / greatest(1, least(c.y1 - c.y0, n.y1 - n.y0))::DOUBLE >= 0.55
                    AND (greatest(c.x1, n.x1) - least(c.x0, n.x0)) / greatest(c.x1 - c.x0, n.x1 - n.x0, 1)::DOUBLE <= 1.8)
                  OR (n.y0 - c.y1 <= greatest(12, floor(least(c.y1 - c.y0, n.y1 - n.y0) * 0.35::DOUBLE)) AND {_H_SHARE})) AS joins FROM (
                  SELECT w.page_id, w.row, step, done, done[-1] AS c, bs[step + 1] AS n FROM walk w JOIN line l ON l.page_id = w.page_id AND l.row = w.row AND step < len(bs)))),
            ended AS (SELECT w.page_id, unnest(done) AS b FROM walk w JOIN line l ON l.page_id = w.page_id AND l.row = w.row AND step = len(bs)),
            stack AS (SELECT page_id, NULL::{_BOX_TYPE} AS cur, list(b ORDER BY b.y0, b.x0, b.x1, b.y1, b.area) AS todo, []::{_BOX_TYPE}[] AS kept, []::{_BOX_TYPE}[] AS done, 0 AS step FROM ended GROUP BY 1
              UNION ALL SELECT page_id,
                CASE WHEN c IS NULL THEN n WHEN n IS NULL THEN NULL WHEN joins THEN {_UNION}::{_BOX_TYPE} ELSE c END,
                CASE WHEN n IS NULL THEN kept ELSE todo[2:] END,
                CASE WHEN n IS NULL THEN []::{_BOX_TYPE}[] WHEN c IS NULL OR joins THEN kept ELSE list_append(kept, n) END,
                CASE WHEN c IS NOT NULL AND n IS NULL THEN list_append(done, c) ELSE done END, step + 1 FROM (
                SELECT *, coalesce({_MERGED} AND {_H_SHARE} AND n.y0 - c.y1 <= greatest(16, floor(least(c.y1 - c.y0, n.y1 - n.y0) * 0.12::DOUBLE))
                  AND (greatest(c.y1, n.y1) - least(c.y0, n.y0)) / greatest(c.y1 - c.y0, n.y1 - n.y0, 1)::DOUBLE <= 1.65, false) AS joins FROM (
                  SELECT *, cur AS c, todo[1] AS n FROM stack WHERE cur IS NOT NULL OR len(todo) > 0)))
            SELECT page_id, b.x0, b.y0, b.x1, b.y1 FROM (SELECT page_id, unnest(done) AS b FROM stack WHERE cur IS NULL AND len(todo) = 0)""",
        ).replace("\n, line AS", ",\nline AS")
    ),
)
def broken_part_merge(spark: SparkSession, root: str) -> DataFrame:
    merged = Y.merge_broken_parts(T.scattered_boxes(spark, root), T.scattered_ink(spark, root))
    return merged.select("page_id", "x0", "y0", "x1", "y1")


# Blocks of 5 by 9 pixels grow together where they touch, at corners too, and not across a gap of one block; so a flood
# over the eight neighbours of a block finds the components, with their branches, holes and diagonals.
@query(
    "a18_grid_components",
    recursive(
        with_ctes(
            ["pixels"],
            """, ink AS (SELECT page_id, y, x FROM pixels WHERE v > 0.18),
            flood AS (SELECT page_id, y, x, y * 8 + x AS seed FROM ink
              UNION SELECT i.page_id, i.y, i.x, f.seed FROM flood f JOIN ink i ON i.page_id = f.page_id AND abs(i.y - f.y) <= 1 AND abs(i.x - f.x) <= 1 AND f.seed < i.y * 8 + i.x),
            least_seed AS (SELECT page_id, y, x, min(seed) AS seed FROM flood GROUP BY 1, 2, 3)
            SELECT page_id, CAST(5 * min(x) AS INTEGER) AS x0, CAST(9 * min(y) AS INTEGER) AS y0, CAST(5 * max(x) + 5 AS INTEGER) AS x1, CAST(9 * max(y) + 9 AS INTEGER) AS y1, 45 * count(*) AS pixels
            FROM least_seed GROUP BY page_id, seed""",
        ).replace("\n, ink AS", ",\nink AS")
    ),
)
def grid_components(spark: SparkSession, root: str) -> DataFrame:
    blocks = I.ink_only(T.grid_pixels(spark, root)).select("page_id", "y", "x")
    tall = blocks.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(4))))
    ink = tall.select("page_id", (F.col("y") * 9 + F.col("dy")).alias("y"), (F.col("x") * 5 + F.col("dx")).alias("x"))
    return I.component_boxes(ink).select("page_id", "x0", "y0", "x1", "y1", "pixels")


@query("layout_digit_regions")
def digit_regions(spark: SparkSession, root: str) -> DataFrame:
    ink = T.word_ink(spark, root)
    pages = ink.groupBy("page_id").agg((F.max("x") + 3).alias("width"), (F.max("y") + 3).alias("height"))
    return page_layout.digit_regions(ink, pages).select("page_id", "row", "place", "px0", "py0", "px1", "py1")


@query("layout_character_regions")
def character_regions(spark: SparkSession, root: str) -> DataFrame:
    ink = T.scattered_ink(spark, root)
    pages = ink.groupBy("page_id").agg((F.max("x") + 3).alias("width"), (F.max("y") + 3).alias("height"))
    regions = page_layout.character_regions(ink, pages)
    return page_layout.split_character_regions(regions, ink).select("region_id", "x0", "y0", "width", "height")


@query("layout_page_texts")
def page_texts(spark: SparkSession, root: str) -> DataFrame:
    out = page_layout.page_texts(T.predictions(spark, root))
    return out.select("page_id", "display", "raw_sequence", F.array_join("notes", " ").alias("notes"))
