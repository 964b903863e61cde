"""Queries that drain a stream over the given tables and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.operators import feedback as B
from glyphloom.plans import standins as T
from glyphloom.plans.registry import query, rounded
from glyphloom.plans.standins import with_ctes
from glyphloom.session import scratch_path
from glyphloom.streaming import feedback_stream as S


@query(
    "x01_feedback_stream",
    """SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM (SELECT CASE event_id % 11 WHEN 1 THEN 'Type the correct character before saving.'
      WHEN 2 THEN 'Character corrections must be exactly one character.' WHEN 3 THEN 'Correction request is malformed.'
      WHEN 4 THEN 'Correction request is malformed.' WHEN 5 THEN 'Correction request is malformed.'
      WHEN 7 THEN 'Whole-result corrections must match the detected character count.'
      WHEN 8 THEN CASE WHEN event_id % 4 <> 0 THEN 'Practice correction is malformed.' END
      WHEN 9 THEN CASE WHEN event_id % 4 <> 0 THEN 'Practice correction is malformed.' ELSE 'Practice corrections must use a practice label.' END
      WHEN 10 THEN 'Correction request is malformed.' END AS reason FROM events) GROUP BY 1""",
)
def feedback_stream(spark: SparkSession, root: str) -> DataFrame:
    base = scratch_path(spark)
    T.form_bodies(spark, root).select("body").write.text(f"{base}/bodies")
    stream = S.write_feedback(
        S.read_bodies(spark, f"{base}/bodies"), f"{base}/log", f"{base}/quarantine", f"{base}/checkpoint"
    )
    stream.awaitTermination()
    log = spark.read.text(f"{base}/log").select(F.lit("accepted").alias("outcome"))
    refused = spark.read.parquet(f"{base}/quarantine").select(F.col("reason").alias("outcome"))
    return log.unionByName(refused).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "x02_live_coverage",
    with_ctes(
        ["fb"],
        f"""SELECT count(*) AS total_labels, count(*) FILTER (count >= 20) AS ready_labels, CAST(sum(count) AS BIGINT) AS samples,
        CAST(sum(greatest(20 - count, 0)) AS BIGINT) AS needed_samples, round(100.0::DOUBLE * sum(count) / (count(*) * 20), 6) AS coverage_percent FROM (
        SELECT p.label, count(i.label) AS count FROM (SELECT DISTINCT substr('{"".join(c if c != "'" else "''" for c in B.PRIORITY_LABELS)}', CAST(i AS INTEGER), 1) AS label
          FROM range(1, {len(B.PRIORITY_LABELS) + 1}) r(i)) p LEFT JOIN (
          SELECT c1 AS label FROM fb WHERE event_id % 50 <> 0 AND image_id <> '' AND (NOT two OR (n_boxes = 2 AND c1 <> chr(92) AND c2 <> chr(92)))
          UNION ALL SELECT c2 FROM fb WHERE event_id % 50 <> 0 AND image_id <> '' AND n_boxes = 2 AND c1 <> chr(92) AND c2 <> chr(92)) i USING (label) GROUP BY 1)""",
    ),
)
def live_coverage(spark: SparkSession, root: str) -> DataFrame:
    base = scratch_path(spark)
    T.correction_lines(spark, root).select("value").write.text(f"{base}/lines")
    lines = spark.readStream.option("maxFilesPerTrigger", 4).text(f"{base}/lines")
    priority = B.priority_table(spark, {"character": B.PRIORITY_LABELS})

    def publish(report: DataFrame, batch_id: int) -> None:
        report.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/reports/batch_no={batch_id}")

    S.write_live_coverage(lines, priority, publish, f"{base}/checkpoint").awaitTermination()
    reports = spark.read.parquet(f"{base}/reports")
    latest = reports.groupBy("recognizer").agg(F.max_by(F.struct(*reports.columns), "batch_id").alias("r")).select("r.*")
    return latest.select(
        "total_labels", "ready_labels", "samples", "needed_samples", rounded("coverage_percent").alias("coverage_percent")
    )


@query("x03_upload_stream", "SELECT sha256(text) AS image_id, count(DISTINCT text) AS copies FROM conversations GROUP BY 1")
def upload_stream(spark: SparkSession, root: str) -> DataFrame:
    base = scratch_path(spark)
    content = T.table(spark, root, "conversations").select(F.encode("text", "utf-8").alias("content"))
    # Every image arrives twice.
    content.unionByName(content).repartition(6).write.parquet(f"{base}/uploads")
    uploads = spark.readStream.schema("content binary").option("maxFilesPerTrigger", 2).parquet(f"{base}/uploads")
    S.store_uploads(uploads, f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return S.stored_uploads(spark, f"{base}/store").groupBy("image_id").agg(F.count("*").alias("copies"))
