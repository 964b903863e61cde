"""Pen-stroke text files and the normalization of stroke points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions.ranking import first_n
from glyphloom.session import cut_lineage
from glyphloom.sources.manifests import MANIFEST_ASCII

# --- fixed values -------------------------------------------------------------------
CANVAS, PADDING = 96, 10
POINT = "struct<x:int,y:int>"


BLOCK_LINES = 100_000
"""Most lines of a block."""


def read_stroke_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line, text) of pen files, read by Spark's own text source in as many splits as it likes.

    A split knows where in its file it begins, and rows of a split come in order; lines are counted
    per split, and one small table of splits says how many lines of the file come before each.
    Lines are written once with their numbers, which later steps read several times. A block is named
    by the line it begins at and has ``BLOCK_LINES`` at most, however large the split.
    """

    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"),
        F.monotonically_increasing_id().alias("_id"),
    )
    rows = cut_lineage(rows.select("path", "block", "_id", _line_text("raw").alias("text")))
    blocks = rows.groupBy("path", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = F.coalesce(F.sum("_lines").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut_lineage(blocks.withColumn("_before", before).drop("_lines"))
    line = F.col("_before") + F.col("_id") - F.col("_first")
    numbered = rows.join(offsets, ["path", "block"]).select("path", "_before", line.alias("line"), "text")
    block = F.greatest("_before", F.floor(F.col("line") / BLOCK_LINES) * BLOCK_LINES)
    return cut_lineage(numbered.select("path", block.alias("block"), "line", "text"))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, block, line, text) of whole files held as values (path, value)."""

    lines = files.select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "raw"))
    return lines.select("path", F.floor(F.col("line") / BLOCK_LINES).alias("block"), F.col("line").cast("long").alias("line"), _line_text("raw").alias("text"))


def _line_text(raw: str) -> Column:
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def _ahead(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the largest ``value`` of the file's earlier rows: inside a block by a window, over blocks by their own maxima."""

    inside = W.partitionBy("path", "block").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    blocks = df.groupBy("path", "block").agg(F.max(value).alias("_most"))
    carried = blocks.withColumn("_carried", F.max("_most").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    own = df.withColumn(name, F.max(value).over(inside))
    return own.join(carried.select("path", "block", "_carried"), ["path", "block"]).withColumn(name, F.greatest(name, "_carried")).drop("_carried")


def parse_strokes(files: DataFrame, labels: str = MANIFEST_ASCII) -> DataFrame:
    """:func:`parse_stroke_lines` of whole files held as values (path, value)."""

    return parse_stroke_lines(lines_of(files), labels)


def parse_stroke_lines(lines: DataFrame, labels: str = MANIFEST_ASCII) -> DataFrame:
    """(path, line, label, session, strokes) of every usable record, in file order.

    A record is a ``WORD`` line, a ``NUMSTROKES n`` line and ``n`` more lines, of
    which those that are no ``POINTS`` are skipped. Lines a record takes up cannot
    open another one; this only matters where records overlap, so the ordered pass
    runs over such stretches of ``WORD`` lines alone. No step orders a whole file: a
    line meets its neighbour by number, and what is open is carried from block to block.
    """

    following = lines.filter(F.col("text").startswith("NUMSTROKES ")).select("path", (F.col("line") - 1).alias("line"), F.col("text").alias("_next"))
    words = (
        lines.filter(F.col("text").rlike(r"^WORD \S+ \S"))
        .join(following, ["path", "line"], "left")
        .withColumn("label", F.regexp_extract("text", r"^WORD (\S+) ", 1))
        .withColumn("session", F.regexp_extract("text", r"^WORD \S+ (.*)$", 1))
        .withColumn("n", F.regexp_extract("_next", r"^NUMSTROKES (\d+)$", 1).try_cast("int"))
        .withColumn("reach", F.col("line") + 1 + F.coalesce("n", F.lit(0)))
    )
    reached = _ahead(words, "reach", "_reached")
    starts = reached.withColumn("_start", F.when(F.coalesce(F.col("line") > F.col("_reached"), F.lit(True)), F.col("line")))
    # A stretch is named by the line that begins it: the row's own, or the last one before it.
    stretched = _ahead(starts, "_start", "_last").withColumn("_stretch", F.coalesce("_start", "_last"))
    record = F.struct("line", "reach", "label", "session", "n")
    grouped = stretched.groupBy("path", "_stretch").agg(F.array_sort(F.collect_list(record)).alias("_w"))
    first = F.slice("_w", 1, 1)
    opened = F.when(F.size("_w") == 1, F.col("_w")).otherwise(
        F.aggregate(
            F.slice("_w", F.lit(2), F.size("_w")), first,
            lambda acc, w: F.when(w["line"] > F.element_at(acc, -1)["reach"], F.concat(acc, F.array(w))).otherwise(acc),
        )
    )
    records = (
        grouped.select("path", F.explode(opened).alias("w"))
        .select("path", "w.*")
        .filter(F.col("n").isNotNull() & (F.length("label") == 1) & F.lit(labels).contains(F.col("label")))
    )
    numbers = F.transform(F.split("text", " "), lambda v: v.try_cast("int"))
    points = lines.filter(F.col("text").rlike(r"^POINTS \d+ #( -?\d+)+$")).select(
        "path", F.col("line").alias("point_line"), F.get(numbers, F.lit(1)).alias("k"),
        F.slice(numbers, F.lit(4), F.size(numbers)).alias("values"),
    )
    pairs = F.least(F.floor(F.size("values") / 2), F.col("k")).cast("int")
    stroke = F.transform(
        F.sequence(F.lit(1), pairs),
        lambda i: F.struct(
            F.element_at("values", i * 2 - 1).alias("x"), F.element_at("values", i * 2).alias("y")
        ),
    )
    strokes = points.filter(pairs >= 1).select("path", "point_line", stroke.alias("stroke"))
    owned = records.filter("n > 0").withColumn(
        "point_line", F.explode(F.sequence(F.col("line") + 2, F.col("reach")))
    )
    return (
        owned.join(strokes, ["path", "point_line"])
        .groupBy("path", "line", "label", "session")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("point_line", "stroke"))), lambda s: s["stroke"]).alias("strokes"))
    )


def normalize_strokes(strokes: Column, size: int = CANVAS, padding: int = PADDING) -> Column:
    """Scale by the longer side into a padded square, centre, round half to even."""

    points = F.flatten(strokes)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x_min, y_min = F.array_min(xs), F.array_min(ys)
    width = F.greatest(F.array_max(xs) - x_min, F.lit(1))
    height = F.greatest(F.array_max(ys) - y_min, F.lit(1))
    scale = F.lit(float(max(size - padding * 2, 1))) / F.greatest(width, height)
    dx, dy = (size - width * scale) / 2.0, (size - height * scale) / 2.0
    return F.transform(
        strokes,
        lambda s: F.transform(
            s,
            lambda p: F.struct(
                F.bround((p["x"] - x_min) * scale + dx).cast("int").alias("x"),
                F.bround((p["y"] - y_min) * scale + dy).cast("int").alias("y"),
            ),
        ),
    )


def limit_per_label(samples: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` samples of each label in file order."""

    if n is None:
        return samples
    return first_n(samples, ["label"], [F.col("path"), F.col("line")], n)
