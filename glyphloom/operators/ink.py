"""Ink tables: polarity, components, boxes, shape features and shape labels.

Ink is one row per pixel, ``(page_id, y, x, v)``. Everything that looks at
neighbouring pixels works on horizontal runs, which are far fewer, and everything
that looks inside boxes meets its pixels through fixed-size tiles: an equi-join
whose groups do not grow with the page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.operators import bands
from glyphloom.operators.components import contracted_components
from glyphloom.session import by_shuffle, cut_lineage

# --- fixed values: ink threshold, normalization, component limits -------------------
INK_FLOOR = 0.18
BRIGHT_BORDER = 0.5
MEAN_STD = {"digits": (0.1307, 0.3081), "letters": (0.1736, 0.3248), "characters": (0.173, 0.331)}
MIN_PAGE_INK = 20
MIN_COMPONENT_PIXELS = 12
MIN_BOX_AREA = 20
DILATION = 2

TILE = 64
TILES = 1000


# ---------------------------------------------------------------- normalization


def normalize_ink(pixels: DataFrame, page: str = "page_id") -> DataFrame:
    """Make ink bright and clear faint pixels, page by page.

    ``pixels`` is the full grid (page, y, x, v, width, height). The border median,
    corners counted twice, tells a bright page, which is inverted. The border pixels
    are aggregated before the join back, which carries one row per page.
    """

    at_rows = (F.col("y") == 0).cast("int") + (F.col("y") == F.col("height") - 1).cast("int")
    at_columns = (F.col("x") == 0).cast("int") + (F.col("x") == F.col("width") - 1).cast("int")
    border = pixels.withColumn("_times", at_rows + at_columns).filter(F.col("_times") > 0)
    bright = border.groupBy(page).agg(
        (F.percentile("v", F.lit(0.5), F.col("_times")) > BRIGHT_BORDER).alias("_bright")
    )
    inverted = F.when(F.col("_bright"), 1.0 - F.col("v")).otherwise(F.col("v"))
    return (
        pixels.join(by_shuffle(bright), page)
        .withColumn("v", F.when(inverted < INK_FLOOR, 0.0).otherwise(inverted))
        .drop("_bright")
    )


def standardize(value: Column, family: str = "digits") -> Column:
    mean, std = MEAN_STD[family]
    return (value - mean) / std


def transpose(pixels: DataFrame) -> DataFrame:
    """A quarter turn back and a mirror: x and y change places."""

    swapped = {"x": "y", "y": "x", "width": "height", "height": "width"}
    return pixels.select(*[F.col(swapped.get(c, c)).alias(c) if c in swapped else F.col(c) for c in pixels.columns])


def ink_only(pixels: DataFrame) -> DataFrame:
    return pixels.filter(F.col("v") > INK_FLOOR)


# ---------------------------------------------------------------- runs


def horizontal_runs(ink: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, y, xa, xb): maximal stretches of ink, both ends included."""

    order = W.partitionBy(page, "y").orderBy("x")
    return (
        ink.select(page, "y", "x")
        .withColumn("_island", F.col("x") - F.row_number().over(order))
        .groupBy(page, "y", "_island")
        .agg(F.min("x").alias("xa"), F.max("x").alias("xb"))
        .drop("_island")
    )


def _union_intervals(intervals: DataFrame, page: str) -> DataFrame:
    """Join overlapping or touching intervals of one pixel row."""

    row = W.partitionBy(page, "y").orderBy("xa", "xb")
    reach = F.max("xb").over(row.rowsBetween(W.unboundedPreceding, -1))
    return (
        intervals.withColumn("_starts", F.coalesce(F.col("xa") > reach + 1, F.lit(True)).cast("int"))
        .withColumn("_island", F.sum("_starts").over(row.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(page, "y", "_island")
        .agg(F.min("xa").alias("xa"), F.max("xb").alias("xb"))
        .drop("_island")
    )


def dilate_runs(runs: DataFrame, page: str = "page_id", steps: int = DILATION) -> DataFrame:
    """Grow ink by a diamond of ``steps``: a run ``dy`` rows away grows ``steps - |dy|``.

    ``width`` and ``height`` of the page clip the result when present.
    """

    grown = runs.withColumn("_dy", F.explode(F.array(*[F.lit(d) for d in range(-steps, steps + 1)])))
    reach = F.lit(steps) - F.abs("_dy")
    grown = grown.withColumn("y", F.col("y") + F.col("_dy")).withColumn("xa", F.greatest(F.lit(0), F.col("xa") - reach))
    grown = grown.withColumn("xb", F.col("xb") + reach).filter(F.col("y") >= 0)
    if "width" in runs.columns:
        grown = grown.withColumn("xb", F.least(F.col("xb"), F.col("width") - 1)).filter(F.col("y") < F.col("height"))
    return _union_intervals(grown.select(page, "y", "xa", "xb"), page)


def _tiles(lo: Column, hi: Column) -> Column:
    """Tile numbers an inclusive interval touches."""

    return F.sequence(F.floor(lo / TILE), F.floor(hi / TILE))


def component_boxes(
    ink: DataFrame,
    page: str = "page_id",
    min_pixels: int = MIN_COMPONENT_PIXELS,
    dilation: int = DILATION,
    min_page_ink: int = MIN_PAGE_INK,
    min_box_area: int = MIN_BOX_AREA,
    columns: DataFrame | None = None,
) -> DataFrame:
    """(page, component, x0, y0, x1, y1, pixels): tight half-open boxes of joined ink.

    Pixels join through the dilated ink but boxes and counts use the true ink. A component's
    number is the row and first column of its first dilated run. Pages with less than 20 ink
    pixels have no components at all. A page is cut into bands of pixel rows; each band is solved
    on its own, and only components that reach the row two bands share are joined by contraction.
    Ink is shuffled once, by page and band; tiles of its index and no pixels, if ``columns`` has it.
    """

    parts = cut_lineage(_band_parts(ink, page, dilation) if columns is None else _tile_parts(columns, page, dilation))
    shared = parts.filter("border IS NOT NULL")
    edges = shared.groupBy(page, "border").agg(F.min("node").alias("src"), F.max("node").alias("dst"))
    merged = contracted_components(edges, [page])
    solved = parts.filter("border IS NULL").join(by_shuffle(merged), [page, "node"], "left")
    boxes = solved.groupBy(page, F.coalesce("component", "node").alias("component")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.sum("pixels").alias("pixels"), F.sum("grown").alias("_grown"),
    )
    inked = boxes.groupBy(page).agg(F.sum("pixels").alias("_ink")).filter(F.col("_ink") >= min_page_ink)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    large = (F.col("pixels") >= min_pixels) & (F.col("_grown") >= min_pixels) & (area >= min_box_area)
    return boxes.join(by_shuffle(inked.select(page)), page, "left_semi").filter(large).drop("_grown")


def _band_parts(ink: DataFrame, page: str, dilation: int) -> DataFrame:
    """Components inside each band of TILE pixel rows, and where they touch the next band.

    A row with a null ``border`` is a component of one band: (page, node, box of its true ink in
    the band, pixels, grown). The others say that a component has the dilated run ``border``, on
    the first row of the lower band, which both bands work out. A band sees as many more pixel
    rows as dilation needs.
    """

    y = F.col("y").cast("long")
    first = F.greatest(F.lit(0), F.ceil((y - TILE - dilation) / TILE))
    last = F.floor((y + dilation) / TILE)
    banded = ink.select(page, F.explode(F.sequence(first, last)).alias("_band"), y.alias("y"), F.col("x").cast("long").alias("x"))
    # Pixels are sorted once and become runs in the task: a window and an aggregation would each hold them anew. The
    # number of tasks is given, since Spark would put partitions together by their compressed size, a small part of that in memory.
    spark = ink.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = banded.repartition(tasks, page, "_band").sortWithinPartitions(page, "_band", "y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bands.whole_groups(batches, 2):
            yield bands.parts(bands.runs(part), dilation, TILE)

    return dealt.mapInArrow(run, _parts_schema(ink, page))


def _parts_schema(ink: DataFrame, page: str) -> T.StructType:
    fields = "node bigint, border bigint, x0 int, y0 int, x1 int, y1 int, pixels bigint, grown bigint"
    return T.StructType([T.StructField(page, ink.schema[page].dataType), *T.StructType.fromDDL(fields)])


def _tile_parts(columns: DataFrame, page: str, dilation: int) -> DataFrame:
    """:func:`_band_parts` of the index ``columns``: a band gets its own tiles and what dilation reaches of the next ones."""

    y = F.col("_ty") * TILE
    first, last = F.greatest(F.lit(0), F.ceil((y - TILE - dilation) / TILE)), F.floor((y + TILE - 1 + dilation) / TILE)
    tiles = held_columns(columns, page).select(page, F.explode(F.sequence(first, last)).alias("_band"), "_ty", "_tx", "_xs", "_bits")
    away = F.col("_band") - F.col("_ty")
    upper, lower = ((1 << (dilation + 1)) - 1, -1 << (TILE - dilation)) if dilation < TILE - 2 else (-1, -1)
    rows = F.when(away == -1, F.lit(upper).cast("long")).when((away == 1) & F.lit(dilation > 0), F.lit(max(lower, -(1 << 63))).cast("long")).otherwise(F.lit(-1).cast("long"))
    masked = F.zip_with("_xs", "_bits", lambda x, bits: F.struct(x.alias("x"), bits.bitwiseAND(F.col("_rows")).alias("bits")))
    seen = tiles.withColumn("_rows", rows).withColumn("_c", F.filter(masked, lambda c: c["bits"] != 0)).filter(F.size("_c") > 0)
    banded = seen.select(page, "_band", "_ty", "_tx", F.col("_c.x").alias("_xs"), F.col("_c.bits").alias("_bits"))
    spark = columns.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = banded.repartition(tasks, page, "_band").sortWithinPartitions(page, "_band", "_ty", "_tx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A tile holds up to 4,096 pixels, so few are looked at together.
        few = (batch.slice(k, TILES) for batch in batches for k in range(0, batch.num_rows, TILES))
        for part in bands.whole_groups(few, 2):
            found = bands.tile_runs(part, dilation, TILE)
            if found.num_rows:  # a band may see none of the rows that a tile has ink in
                yield bands.parts(found, dilation, TILE)

    return dealt.mapInArrow(run, _parts_schema(columns, page))


# ---------------------------------------------------------------- ink in boxes


def ink_in_boxes(boxes: DataFrame, ink: DataFrame, page: str = "page_id", columns: list[str] | None = None) -> DataFrame:
    """Every (box, ink pixel) pair with the pixel inside the half-open box.

    Boxes are laid out on tiles; a pixel has one tile, so a pair meets once and no
    join group is larger than a tile.
    """

    wanted = columns or boxes.columns
    tiled = boxes.withColumn("_tx", F.explode(_tiles(F.col("x0"), F.col("x1") - 1))).withColumn(
        "_ty", F.explode(_tiles(F.col("y0"), F.col("y1") - 1))
    )
    pixels = ink.select(
        page, "y", "x", F.floor(F.col("x") / TILE).alias("_tx"), F.floor(F.col("y") / TILE).alias("_ty")
    )
    inside = (
        (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
        & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    )
    return by_shuffle(tiled).join(pixels, [page, "_tx", "_ty"]).filter(inside).select(*wanted, "y", "x")


def ink_columns(ink: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, _tx, _ty, x, bits): an index of ink, one row for each pixel column of a tile.

    ``bits`` has bit y % 64 set for each inked row of the tile, so ink in any stretch of rows is a
    bit count. Pixels are put together before the shuffle.
    """

    bit = F.expr("shiftleft(1L, CAST(y % 64 AS INT))")
    return (
        ink.groupBy(page, F.floor(F.col("x") / TILE).alias("_tx"), F.floor(F.col("y") / TILE).alias("_ty"), "x")
        .agg(F.bit_or(bit).alias("bits"))
    )


def held_columns(columns: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, _tx, _ty, _xs, _bits): the index of :func:`ink_columns` with a tile's columns, TILE at most, in one row.

    ``_xs`` are their places in the tile, in order; so a tile goes through a shuffle in few bytes.
    """

    placed = F.struct((F.col("x") - F.col("_tx") * TILE).cast("tinyint").alias("x"), "bits")
    held = columns.groupBy(page, "_tx", "_ty").agg(F.sort_array(F.collect_list(placed)).alias("_c"))
    return held.select(page, "_tx", "_ty", F.col("_c.x").alias("_xs"), F.col("_c.bits").alias("_bits"))


def tiles_in_boxes(boxes: DataFrame, columns: DataFrame, page: str = "page_id", wanted: list[str] | None = None) -> DataFrame:
    """``wanted`` of each half-open box with _tx, _ty and the ``_columns`` (x, bits) inside it of each tile that it meets."""

    tiled = boxes.withColumn("_tx", F.explode(_tiles(F.col("x0"), F.col("x1") - 1))).withColumn(
        "_ty", F.explode(_tiles(F.col("y0"), F.col("y1") - 1))
    )
    # Rows from the box's first to its last one, as bits of this tile.
    low = F.greatest(F.lit(0), F.col("y0") - F.col("_ty") * TILE).cast("int")
    high = F.least(F.lit(TILE), F.col("y1") - F.col("_ty") * TILE).cast("int")
    ones = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(TILE) - (high - low)), low)
    left, right = F.col("x0") - F.col("_tx") * TILE, F.col("x1") - F.col("_tx") * TILE
    met = by_shuffle(tiled.withColumn("_ones", ones)).join(held_columns(columns, page), [page, "_tx", "_ty"])
    masked = F.zip_with("_xs", "_bits", lambda x, bits: F.struct(x.alias("x"), bits.bitwiseAND(F.col("_ones")).alias("bits")))
    inside = F.filter(masked, lambda c: (c["x"] >= left) & (c["x"] < right) & (c["bits"] != 0))
    return met.select(*(wanted or boxes.columns), "_tx", "_ty", inside.alias("_columns"))


def columns_in_boxes(boxes: DataFrame, columns: DataFrame, page: str = "page_id", wanted: list[str] | None = None) -> DataFrame:
    """``wanted`` of each half-open box with x, the tile row and the ``bits`` inside, for each column of a tile with ink in it."""

    named = wanted or boxes.columns
    apart = tiles_in_boxes(boxes, columns, page, named).select(*named, "_tx", "_ty", F.explode("_columns").alias("_c"))
    x = (F.col("_tx") * TILE + F.col("_c.x")).cast(columns.schema["x"].dataType)
    return apart.select(*named, x.alias("x"), "_ty", F.col("_c.bits").alias("bits"))


def ink_bounds(boxes: DataFrame, columns: DataFrame, page: str, keys: list[str]) -> DataFrame:
    """(keys, n, x0, y0, x1, y1): ink pixels of each box that has any, and the tight box around them."""

    digits = F.lpad(F.bin("bits"), 64, "0")
    first, last = F.instr(F.reverse(digits), "1") - 1, 64 - F.instr(digits, "1")
    row = F.col("_ty") * TILE
    return (
        columns_in_boxes(boxes, columns, page, keys)
        .groupBy(*keys)
        .agg(
            F.sum(F.bit_count("bits")).alias("n"), F.min("x").alias("x0"), F.min(row + first).cast("int").alias("y0"),
            (F.max("x") + 1).alias("x1"), (F.max(row + last) + 1).cast("int").alias("y1"),
        )
    )


def box_ink_area(boxes: DataFrame, columns: DataFrame, box_id: str, page: str = "page_id") -> DataFrame:
    """``area`` of each box: its ink pixels by the index of :func:`ink_columns`, 0 for an empty one."""

    inked = columns_in_boxes(boxes.filter("x1 > x0 and y1 > y0"), columns, page, [page, box_id])
    counted = inked.groupBy(page, box_id).agg(F.sum(F.bit_count("bits")).alias("area"))
    return boxes.join(by_shuffle(counted), [page, box_id], "left").withColumn("area", F.coalesce("area", F.lit(0).cast("long")))


# ---------------------------------------------------------------- shape features


def _at(size: Column, ratio: float) -> Column:
    return F.floor(size * ratio)


def shape_features(region_ink: DataFrame, region: str = "region_id") -> DataFrame:
    """Aspect, density, band spans, coverage, quadrant means and band centroids.

    ``region_ink``: (region, width, height, y, x), region-local ink pixels. Pixel
    rows are aggregated first, so the second step sees one row per pixel row.
    """

    w, h, x, y = F.col("width"), F.col("height"), F.col("x"), F.col("y")
    lines = region_ink.groupBy(region, "width", "height", "y").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
        F.count_if(x < F.greatest(F.lit(1), _at(w, 0.38))).alias("n38"),
        F.count_if(x < F.greatest(F.lit(1), _at(w, 0.45))).alias("n45"),
    )
    one = F.lit(1)
    bands = {
        "top": y < F.greatest(one, _at(h, 0.25)),
        "low": y >= _at(h, 0.55),
        "middle": (y >= _at(h, 0.35)) & (y < F.greatest(_at(h, 0.65), _at(h, 0.35) + 1)),
        "bar": (y >= _at(h, 0.42)) & (y < F.greatest(_at(h, 0.62), _at(h, 0.42) + 1)),
        "bottom": y >= _at(h, 0.75),
    }

    def span(band: Column) -> Column:
        lo, hi = F.min(F.when(band, F.col("x_lo"))), F.max(F.when(band, F.col("x_hi")))
        return F.coalesce((hi - lo + 1) / F.greatest(w, one), F.lit(0.0))

    def center(start: float, stop: float) -> Column:
        band = (y >= _at(h, start)) & (y < F.greatest(_at(h, stop), _at(h, start) + 1))
        return F.sum(F.when(band, F.col("sx"))) / F.sum(F.when(band, F.col("n"))) / F.greatest(w, one)

    def filled(rows: Column, column: str, area_rows: Column, area_columns: Column) -> Column:
        # An empty quadrant has no mean.
        area = area_rows * area_columns
        return F.when(area > 0, F.coalesce(F.sum(F.when(rows, F.col(column))), F.lit(0)) / area)

    cx, cy = F.sum("sx") / F.sum("n"), F.sum(y * F.col("n")) / F.sum("n")
    tight_w = F.max("x_hi") - F.min("x_lo") + 1
    tight_h = F.max("y") - F.min("y") + 1
    scale = 20.0 / F.greatest(tight_w, tight_h)

    def shift(size: Column, centroid: Column, start: Column) -> Column:
        # Where the centroid lands after scaling the tight crop to 20 and centring it on 28.
        new = F.greatest(one, F.bround(size * scale).cast("int"))
        middle = F.floor((28 - new) / 2) + (centroid - start + 0.5) * new / size - 0.5
        return F.bround(14 - middle).cast("int")

    return lines.groupBy(region, "width", "height").agg(
        (w / F.greatest(h, one)).alias("aspect"),
        (F.sum("n") / (w * h)).alias("density"),
        *[span(band).alias(f"{name}_span") for name, band in bands.items()],
        (F.count_if(F.col("x_hi") >= _at(w, 0.58)) / F.greatest(h, one)).alias("right_coverage"),
        filled(y >= _at(h, 0.62), "n38", h - _at(h, 0.62), F.least(w, F.greatest(one, _at(w, 0.38)))).alias("lower_left"),
        filled(
            y < F.greatest(one, _at(h, 0.45)), "n45",
            F.least(h, F.greatest(one, _at(h, 0.45))), F.least(w, F.greatest(one, _at(w, 0.45))),
        ).alias("top_left"),
        *[center(i / 5, (i + 1) / 5).alias(f"center{i}") for i in range(5)],
        F.min("x_lo").alias("tight_x0"), F.min("y").alias("tight_y0"),
        (F.max("x_hi") + 1).alias("tight_x1"), (F.max("y") + 1).alias("tight_y1"),
        shift(tight_w, cx, F.min("x_lo")).alias("shift_x"),
        shift(tight_h, cy, F.min("y")).alias("shift_y"),
    )


def shape_flags(features: DataFrame) -> DataFrame:
    """``like_four``, ``like_seven``, ``like_one`` and a parenthesis label."""

    c = F.col
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    thin = c("aspect").between(0.32, 0.72) & (c("density") <= 0.08) & (c("middle_span") <= 0.36) & (
        c("bottom_span") <= 0.38
    )
    bands = F.array(*[f"center{i}" for i in range(5)])
    whole = thin & F.forall(bands, lambda v: v.isNotNull())
    opens = (c("center2") <= c("center0") - 0.15) & (c("center2") <= c("center4") - 0.10)
    closes = (
        (c("top_span") <= 0.58) & (c("center2") >= c("center0") + 0.15) & (c("center2") >= c("center4") + 0.10)
    )
    return (
        features.withColumn(
            "like_seven",
            yes(c("aspect").between(0.24, 0.62) & (c("top_span") >= 0.48) & (c("low_span") <= 0.22)),
        )
        .withColumn("like_one", yes((c("aspect") <= 0.34) & (c("top_span") <= 0.22) & (c("low_span") <= 0.24)))
        .withColumn(
            "like_four",
            yes(
                c("aspect").between(0.35, 0.85) & (c("bar_span") >= 0.45) & (c("right_coverage") >= 0.55)
                & (c("lower_left") <= 0.10) & (c("top_left") >= 0.015)
            ),
        )
        .withColumn("parenthesis", F.when(whole & opens, "(").when(whole & closes, ")"))
    )


def part_labels(parts: DataFrame, region: str = "region_id") -> DataFrame:
    """``i``, ``!`` or ``:`` from a region's parts: one stem with a dot, or two dots.

    ``parts``: (region, x0, y0, x1, y1, pixels), the components of the undilated
    ink with at least 6 pixels. The main part is the largest.
    """

    main = F.struct("pixels", "x0", "y0", "x1", "y1")
    mains = parts.groupBy(region).agg(F.max(main).alias("m"), F.count("*").alias("n_parts"))
    ranked = parts.join(by_shuffle(mains), region)
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    mw, mh = F.col("m.x1") - F.col("m.x0"), F.col("m.y1") - F.col("m.y0")
    center = (F.col("x0") + F.col("x1")) / 2.0
    main_center = (F.col("m.x0") + F.col("m.x1")) / 2.0
    other = ~(main.eqNullSafe(F.col("m")))
    stem = (mh >= 28) & (mh / F.greatest(mw, F.lit(1)) >= 3.0)
    dot = other & (width <= 24) & (height <= 24)
    aligned = stem & dot & (F.abs(center - main_center) <= F.greatest(F.lit(10), mw * 1.5))
    verdict = F.when(aligned & (F.col("y1") <= F.col("m.y0")), "i").when(
        aligned & (F.col("y0") >= F.col("m.y1")), "!"
    )
    # The largest satellite that decides comes first.
    rank = F.struct(F.col("pixels"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    small = F.struct("y0", "x0", "x1", "y1", (width <= 24).alias("w"), (height <= 24).alias("h"))
    judged = ranked.groupBy(region, "n_parts").agg(
        F.max_by(verdict, F.when(verdict.isNotNull(), rank)).alias("stem_label"),
        F.min(small).alias("a"), F.max(small).alias("b"),
    )
    gap = F.abs((F.col("a.x0") + F.col("a.x1")) / 2.0 - (F.col("b.x0") + F.col("b.x1")) / 2.0)
    colon = (
        (F.col("n_parts") == 2) & F.col("a.w") & F.col("a.h") & F.col("b.w") & F.col("b.h")
        & (gap <= 10) & (F.col("b.y0") > F.col("a.y1"))
    )
    return judged.select(
        region, F.coalesce("stem_label", F.when(colon, ":")).alias("part_label")
    ).filter(F.col("part_label").isNotNull())


def punctuation_labels(region_ink: DataFrame, region: str = "region_id") -> DataFrame:
    """(region, punctuation): a parenthesis if the stroke is one, else the parts' label."""

    strokes = shape_flags(shape_features(region_ink, region)).select(region, "parenthesis")
    pieces = component_boxes(
        region_ink, region, min_pixels=6, dilation=0, min_page_ink=0, min_box_area=0
    )
    parts = part_labels(pieces, region)
    return (
        strokes.join(by_shuffle(parts), region, "left")
        .select(region, F.coalesce("parenthesis", "part_label").alias("punctuation"))
        .filter(F.col("punctuation").isNotNull())
    )
