import glob
import json
import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphloom.operators import feedback as B
from glyphloom.plans import standins as T
from glyphloom.sources import feedback_log
from glyphloom.streaming import feedback_stream as S

ROOT = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_feedback_stream_equals_batch(spark, tmp_path):
    bodies = T.form_bodies(spark, ROOT).select("body")
    bodies.repartition(5).write.text(str(tmp_path / "in"))
    paths = [str(tmp_path / n) for n in ("log", "refused", "ckpt")]
    S.write_feedback(S.read_bodies(spark, str(tmp_path / "in"), 2), *paths).awaitTermination()
    batch = B.validate_corrections(B.decode_forms(bodies))
    timed = [json.loads(r.value) for r in spark.read.text(paths[0]).collect()]
    assert all(r["timestamp"] for r in timed)
    untimed = lambda lines: sorted(json.dumps({**json.loads(v), "timestamp": None}, sort_keys=True) for v in lines)
    assert untimed(json.dumps(r) for r in timed) == untimed(r.value for r in feedback_log.correction_lines(batch.filter("reason is null").drop("reason")).collect())
    count = lambda df: {r.reason: r["count"] for r in df.groupBy("reason").count().collect()}
    assert count(spark.read.parquet(paths[1])) == count(batch.filter("reason is not null"))
    assert len(glob.glob(f"{paths[0]}/batch=*")) > 1


def test_live_coverage_equals_batch(spark, tmp_path):
    lines = T.correction_lines(spark, ROOT).select("value")
    lines.repartition(5).write.text(str(tmp_path / "in"))
    priority = B.priority_table(spark, {"character": B.PRIORITY_LABELS})
    reports = []
    S.write_live_coverage(
        spark.readStream.option("maxFilesPerTrigger", 2).text(str(tmp_path / "in")), priority,
        lambda df, _: reports.append(df.first()), str(tmp_path / "ckpt"),
    ).awaitTermination()
    counts = B.label_counts(B.training_items(feedback_log.parse_corrections(lines), S.CHARACTER_LABELS)).withColumn("recognizer", F.lit("character"))
    assert reports[-1] == B.coverage_report(B.coverage_rows(counts, priority)).first()
    assert len(reports) > 1


def test_live_coverage_keeps_the_state_of_partitions_without_a_priority_label(spark, tmp_path):
    lines = [json.dumps({"image_id": "1", "corrected_label": label, "bbox": {"x": 1}}) for label in "AB~~"]
    spark.createDataFrame([(line,) for line in lines], "value string").repartition(2).write.text(str(tmp_path / "in"))
    priority = B.priority_table(spark, {"character": "AB"})
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    reports = []
    try:
        for k, v in zip(before, ("16", "-1")):
            spark.conf.set(k, v)
        S.write_live_coverage(
            spark.readStream.text(str(tmp_path / "in")), priority, lambda df, _: reports.append(df.first()), str(tmp_path / "ckpt")
        ).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.samples for r in reports] == [2]


def test_upload_store_keeps_one_copy_over_batches_restarts_and_replays(spark, tmp_path):
    def arrive(name, values):
        spark.createDataFrame([(bytearray(v),) for v in values], "content binary").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("content binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = S.store_uploads(stream, str(tmp_path / "store"), str(tmp_path / "ckpt"))
        query.awaitTermination()
        return query

    stored = lambda: sorted(bytes(r.content) for r in S.stored_uploads(spark, str(tmp_path / "store")).collect())
    first = [bytes([i % 7]) for i in range(40)]
    arrive("a", first)
    query = run()
    assert all(not p["stateOperators"] for p in query.recentProgress) and len(query.recentProgress) > 1
    assert stored() == sorted(set(first))
    second = [bytes([i % 11]) for i in range(40)] + [b"", b"long" * 1000]
    arrive("b", second)
    run()  # goes on from the checkpoint
    assert stored() == sorted(set(first + second))
    folders = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "store" / "images").iterdir() if p.name.startswith("batch_no"))
    before = {p.name: p for p in (tmp_path / "store").glob("ids/*/*/*.parquet")}
    last = folders[-1]
    again = spark.createDataFrame([(bytearray(v),) for v in first + second], "content binary")
    S.keep_new_uploads(again, last, str(tmp_path / "store"))  # the last batch runs again, as if its end hadn't been written down
    S.keep_new_uploads(again, last + 1, str(tmp_path / "store"))
    assert stored() == sorted(set(first + second)) and before
    S.keep_new_uploads(again.limit(0), last + 2, str(tmp_path / "store"))
    assert stored() == sorted(set(first + second))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["count"] >= rows[-1]["count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_inventory_row_has_a_query():
    ids = {n.split("_")[0] for n in entry.queries()}
    wanted = {f"s{i:02d}" for i in range(1, 20)} | {f"p{i:02d}" for i in range(1, 21)} | {f"j{i:02d}" for i in range(1, 15)}
    wanted |= {f"a{i:02d}" for i in range(1, 24)} | {f"v{i:02d}" for i in range(1, 13)} | {"t01", "t02", "u01", "u02", "u03", "x01", "x02", "x03", "f01", "f02"}
    assert wanted - ids == set()


def test_no_machine_local_checkpoints_in_the_library():
    for path in glob.glob(f"{HERE}/glyphloom/**/*.py", recursive=True):
        assert "localCheckpoint" not in open(path).read(), path
