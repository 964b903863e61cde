"""The correction log, the upload store, the ingest gate and the crop export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.functions.text import MAX_UPLOAD_BYTES
from glyphloom.operators.ink import ink_in_boxes

# --- fixed values: ingest limits ----------------------------------------------------
MAX_FILES = 20
MAX_DECODE_PIXELS = 60_000_000
MAX_PAGE_PIXELS = 4_000_000

_BOX = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("row", T.IntegerType()),
    ]
)
CORRECTION_SCHEMA = T.StructType(
    [
        T.StructField("correction_kind", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("image_id", T.StringType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("prediction_index", T.IntegerType()),
        T.StructField("original_label", T.StringType()),
        T.StructField("corrected_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("bbox", _BOX),
        T.StructField(
            "prediction_boxes",
            T.ArrayType(T.StructType([T.StructField("original_label", T.StringType()), T.StructField("bbox", _BOX)])),
        ),
        T.StructField("timestamp", T.StringType()),
    ]
)
_WITH_CORRUPT = T.StructType([*CORRECTION_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])


def parse_corrections(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records of a JSONL table; blank and broken lines and rows without image id drop out."""

    carried = [c for c in lines.columns if c != value]
    parsed = lines.filter(F.trim(F.col(value)) != "").select(
        *carried,
        F.from_json(value, _WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
    )
    return parsed.filter("r._corrupt is null and coalesce(r.image_id, '') <> ''").select(
        *carried, *[f"r.{f.name}" for f in CORRECTION_SCHEMA.fields]
    )


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return parse_corrections(spark.read.text(path))


def _sorted_fields(column: Column, kind: T.DataType) -> Column:
    """The same value with struct fields in alphabetical order, all the way down."""

    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.struct(*[_sorted_fields(column[f.name], f.dataType).alias(f.name) for f in fields])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda e: _sorted_fields(e, kind.elementType))
    return column


def json_line(records: DataFrame) -> Column:
    """A record as one JSON object: keys sorted, nulls and non-ASCII kept."""

    row = _sorted_fields(F.struct(*[F.col(c) for c in records.columns]), records.schema)
    return F.to_json(row, {"ignoreNullFields": "false"})


def correction_lines(records: DataFrame) -> DataFrame:
    """(value): the log line of every record."""

    return records.select(json_line(records).alias("value"))


def append_corrections(records: DataFrame, path: str) -> None:
    """Append to the log; every write adds files, so concurrent writers do not meet."""

    correction_lines(records).write.mode("append").text(path)


# ---------------------------------------------------------------- uploads


def upload_ids(uploads: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``image_id``, the SHA-256 of the bytes."""

    return uploads.withColumn("image_id", F.sha2(content, 256))


def new_uploads(uploads: DataFrame, store: DataFrame | None, content: str = "content") -> DataFrame:
    """One row per content that the store does not hold yet."""

    fresh = upload_ids(uploads, content).dropDuplicates(["image_id"])
    return fresh if store is None else fresh.join(store.select("image_id"), "image_id", "left_anti")


def gate_uploads(parts: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` and the size a page is scaled to; empty parts drop out.

    ``parts``: request_id, filename, bytes, width, height (null when unreadable).
    Limits of a request refuse all its parts; limits of an image only that one.
    Request totals are aggregated, then joined back.
    """

    filled = parts.filter("bytes > 0")
    totals = filled.groupBy("request_id").agg(
        F.count("*").alias("_files"), F.sum("bytes").alias("_bytes")
    )
    pixels = F.col("width").cast("long") * F.col("height")
    scale = F.sqrt(F.lit(float(MAX_PAGE_PIXELS)) / pixels)

    def scaled(side: str) -> Column:
        return F.when(pixels <= MAX_PAGE_PIXELS, F.col(side)).otherwise(
            F.greatest(F.lit(1), F.floor(F.col(side) * scale))
        ).cast("int")

    reason = (
        F.when(F.col("_bytes") > MAX_UPLOAD_BYTES, "Upload is too large.")
        .when(F.col("_files") > MAX_FILES, f"Upload {MAX_FILES} or fewer files at a time.")
        .when(pixels.isNull(), "Could not read this as an image.")
        .when(pixels > MAX_DECODE_PIXELS, "Image is too large. Use an image under 60 megapixels.")
    )
    return (
        filled.join(totals, "request_id")
        .withColumn("reject_reason", reason)
        .withColumn("page_width", F.when(reason.isNull(), scaled("width")))
        .withColumn("page_height", F.when(reason.isNull(), scaled("height")))
        .drop("_files", "_bytes")
    )


# ---------------------------------------------------------------- crops


def item_crops(items: DataFrame, ink: DataFrame, image_id: str = "image_id") -> DataFrame:
    """Ink pixels of every training item, relative to its box.

    ``items``: record_index, item_index, label, x0, y0, width, height. Each row also
    has the crop's ``name`` (record_item) and the label's ``code``.
    """

    boxes = items.select(
        image_id, "record_index", "item_index", "label", "x0", "y0",
        (F.col("x0") + F.col("width")).alias("x1"), (F.col("y0") + F.col("height")).alias("y1"),
    )
    wanted = [image_id, "record_index", "item_index", "label", "x0", "y0"]
    inside = ink_in_boxes(boxes, ink, image_id, wanted)
    return inside.select(
        F.ascii("label").alias("code"),
        F.format_string("%05d_%02d", "record_index", "item_index").alias("name"),
        (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"),
    )


def export_crops(items: DataFrame, ink: DataFrame, output: str, image_id: str = "image_id") -> None:
    """Write crops as one folder per code point, replacing the last export."""

    item_crops(items, ink, image_id).write.mode("overwrite").partitionBy("code").parquet(output)
