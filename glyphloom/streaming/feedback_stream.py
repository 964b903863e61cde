"""Structured Streaming forms of the feedback operators.

The batch functions run unchanged inside the streams, so a drained stream and a
batch over the same input give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphloom.functions.labels import CHARACTER_LABELS
from glyphloom.operators.feedback import (
    RECEIVED_AT,
    coverage_report,
    coverage_rows,
    decode_forms,
    label_counts,
    training_items,
    validate_corrections,
)
from glyphloom.session import cut_lineage
from glyphloom.sources.feedback_log import correction_lines, parse_corrections, upload_ids

INDEX_DIGITS = 1
"""Hex digits of an id that name its bucket in the index of stored uploads."""


def read_bodies(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Form bodies, one per line, as they arrive in a folder."""

    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "body")
    )


def accepted_and_refused(bodies: DataFrame) -> DataFrame:
    """Checked records; bodies without a time of their own get the batch's."""

    timed = bodies if RECEIVED_AT in bodies.columns else bodies.withColumn(RECEIVED_AT, F.current_timestamp())
    return validate_corrections(decode_forms(timed))


def write_feedback(
    bodies: DataFrame, log_path: str, quarantine_path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Accepted records to the log, refused ones with their reason to the quarantine.

    Each batch is validated once and written to a folder named after its id, so a
    batch replayed after a failure overwrites itself and nothing is logged twice.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        checked = accepted_and_refused(batch).persist()
        try:
            good = checked.filter("reason is null").drop("reason")
            correction_lines(good).write.mode("overwrite").text(f"{log_path}/batch={batch_id}")
            checked.filter("reason is not null").write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        finally:
            checked.unpersist()

    writer = bodies.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_label_counts(lines: DataFrame, labels: list[str] = CHARACTER_LABELS) -> DataFrame:
    """Running (label, count) of trainable items; the state has one row per label."""

    return label_counts(training_items(parse_corrections(lines), labels))


def write_live_coverage(
    lines: DataFrame,
    priority: DataFrame,
    publish: Callable[[DataFrame, int], None],
    checkpoint: str,
    recognizer: str = "character",
    available_now: bool = True,
) -> StreamingQuery:
    """Publish the coverage report after every batch of new log lines.

    The counts are written before they are joined: a sort-merge join with the priority table would
    not read the partitions no priority label falls into, and their state would never be committed.
    """

    def report(counts: DataFrame, batch_id: int) -> None:
        tagged = cut_lineage(counts).withColumn("recognizer", F.lit(recognizer))
        publish(coverage_report(coverage_rows(tagged, priority)), batch_id)

    writer = (
        live_label_counts(lines)
        .writeStream.outputMode("complete")
        .foreachBatch(report)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def store_uploads(uploads: DataFrame, store_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the first copy of every content, in ``store_path``/images, one folder for each batch.

    ``uploads``: content. Which ids are stored is told by an index of ids in files, not by the
    stream's state, which stays empty however many images there are; see :func:`keep_new_uploads`.
    """

    writer = uploads.select("content").writeStream.foreachBatch(lambda batch, n: keep_new_uploads(batch, n, store_path))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def keep_new_uploads(batch: DataFrame, batch_id: int, store_path: str) -> None:
    """Store a batch's contents whose ids no earlier batch has.

    The index has one row for each id, in folders by batch and first hex digits of the id. A batch
    reads only the buckets its own ids fall into, and of earlier batches only, so a batch that is
    run again finds what it found before, writes the same folders anew and leaves one copy.
    """

    spark = batch.sparkSession
    if batch_id == 0:  # so that there is an index to read, even if this batch is empty
        batch.limit(0).select(F.lit("").alias("image_id")).write.mode("overwrite").parquet(f"{store_path}/ids/batch_no=-1/bucket=none")
    ids = upload_ids(batch).dropDuplicates(["image_id"]).withColumn("bucket", F.substring("image_id", 1, INDEX_DIGITS))
    fresh = cut_lineage(ids.select("bucket", "image_id", "content"))
    buckets = [row["bucket"] for row in fresh.select("bucket").distinct().collect()]  # 16 ** INDEX_DIGITS at most
    if not buckets:
        return
    if batch_id > 0:
        schema = "image_id string, batch_no long, bucket string"
        index = spark.read.schema(schema).parquet(f"{store_path}/ids").filter(F.col("bucket").isin(buckets) & (F.col("batch_no") < batch_id))
        fresh = cut_lineage(fresh.join(index.select("bucket", "image_id"), ["bucket", "image_id"], "left_anti"))
    fresh.select("image_id", "content").write.mode("overwrite").parquet(f"{store_path}/images/batch_no={batch_id}")
    fresh.select("image_id", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store_path}/ids/batch_no={batch_id}")


def stored_uploads(spark: SparkSession, store_path: str) -> DataFrame:
    """(image_id, content) of all stored images."""

    return spark.read.parquet(f"{store_path}/images").select("image_id", "content")
