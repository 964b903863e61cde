"""Queries on corrections, uploads, sources and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import labels as L
from glyphloom.functions import text as X
from glyphloom.operators import feedback as B
from glyphloom.operators import quality
from glyphloom.plans import standins as T
from glyphloom.plans.registry import query, rounded
from glyphloom.plans.standins import with_ctes
from glyphloom.session import cut_lineage, scratch_path
from glyphloom.sources import feedback_log, folders, manifests, strokes

VOCABULARIES = {"character": L.CHARACTER_LABELS, "folded_alnum": L.FOLDED_LABELS, "mixedcase": L.MIXED_LABELS}
_ALIVE = "event_id % 50 <> 0 AND image_id <> ''"


def corrections(spark: SparkSession, root: str) -> DataFrame:
    return feedback_log.parse_corrections(T.correction_lines(spark, root))


def complete_corrections(spark: SparkSession, root: str) -> DataFrame:
    """Records with a stored image, old sequences given the page's boxes."""

    usable = B.with_source_image(corrections(spark, root), T.stored_images(spark, root))
    return B.backfill_sequence_boxes(usable, T.page_regions(spark, root))


def recognizer_counts(spark: SparkSession, root: str) -> DataFrame:
    items = B.recognizer_items(complete_corrections(spark, root), VOCABULARIES)
    return items.groupBy("recognizer", "label").agg(F.count("*").alias("count"))


# ------------------------------------------------------------------ log and joins


@query(
    "s10_tolerant_log_scan",
    with_ctes(
        ["fb"],
        f"""SELECT event_id, CASE WHEN kind_sel = 1 THEN NULL WHEN two THEN 'sequence' ELSE 'character' END AS correction_kind,
        image_id, corrected_label, k * 1.5::DOUBLE AS x, CAST(n_boxes AS INTEGER) AS boxes FROM fb WHERE {_ALIVE}""",
    ),
)
def tolerant_log_scan(spark: SparkSession, root: str) -> DataFrame:
    return corrections(spark, root).select(
        "event_id", "correction_kind", "image_id", "corrected_label", F.col("bbox.x").alias("x"),
        F.when(F.col("prediction_boxes").isNull(), 0).otherwise(F.size("prediction_boxes")).alias("boxes"),
    )


@query(
    "s11_log_lines",
    """SELECT CAST(octet_length(encode(value)) AS BIGINT) AS bytes, md5(value) AS digest, event_id FROM (
    SELECT event_id, '{"confidence":' || (event_id % 8) * 0.125::DOUBLE || ',"corrected_label":"é' || user_id % 10
    || '","image_id":"' || user_id || '","prediction_index":' || (1 + event_id % 5) || '}' AS value FROM events)""",
)
def log_lines(spark: SparkSession, root: str) -> DataFrame:
    records = T.table(spark, root, "events").select(
        "event_id", (1 + F.col("event_id") % 5).cast("int").alias("prediction_index"), F.col("user_id").cast("string").alias("image_id"),
        F.concat(F.lit("é"), (F.col("user_id") % 10).cast("string")).alias("corrected_label"),
        (F.col("event_id") % 8 * F.lit(0.125)).alias("confidence"),
    )
    keyed = records.withColumn("value", feedback_log.json_line(records.drop("event_id")))
    return keyed.select(F.octet_length("value").cast("long").alias("bytes"), F.md5("value").alias("digest"), "event_id")


@query(
    "j01_corrections_with_image",
    with_ctes(["fb"], f"SELECT event_id, image_id FROM fb WHERE {_ALIVE} AND user_id % 4 <> 0"),
)
def corrections_with_image(spark: SparkSession, root: str) -> DataFrame:
    return B.with_source_image(corrections(spark, root), T.stored_images(spark, root)).select("event_id", "image_id")


@query(
    "j01_replay_cases",
    with_ctes(
        ["fb"],
        f"""SELECT 'f' || event_id || '.png' AS filename, image_id, corrected_label AS target FROM fb
        WHERE {_ALIVE} AND user_id % 4 <> 0 AND two""",
    ),
)
def replay_cases(spark: SparkSession, root: str) -> DataFrame:
    return B.replay_cases(corrections(spark, root), T.stored_images(spark, root))


@query(
    "a08_replay_accuracy",
    with_ctes(
        ["fb"],
        f"""SELECT count(*) AS total, count(*) FILTER (hit) AS correct, round(100.0::DOUBLE * count(*) FILTER (hit) / greatest(count(*), 1), 6) AS accuracy
        FROM (SELECT user_id % 5 <> 1 AND corrected_label = coalesce(CASE WHEN user_id % 2 = 0 THEN best END, 'zz') AS hit FROM fb
        JOIN (SELECT user_id AS u, max(CASE WHEN two THEN corrected_label END) AS best FROM fb GROUP BY 1) ON u = user_id
        WHERE {_ALIVE} AND user_id % 4 <> 0 AND two)""",
    ),
)
def replay_accuracy(spark: SparkSession, root: str) -> DataFrame:
    fb = T.feedback_events(spark, root)
    label = F.when(F.col("two"), F.concat("c1", "c2"))
    pages = fb.groupBy("user_id").agg(F.max(label).alias("best")).filter("user_id % 5 <> 1").select(
        F.col("user_id").cast("string").alias("image_id"),
        F.coalesce(F.when(F.col("user_id") % 2 == 0, F.col("best")), F.lit("zz")).alias("sequence"),
    )
    out = quality.replay_accuracy(B.replay_cases(corrections(spark, root), T.stored_images(spark, root)), pages)
    return out.withColumn("accuracy", rounded("accuracy"))


@query(
    "j03_legacy_box_backfill",
    with_ctes(
        ["fb"],
        f"""SELECT event_id, CAST(CASE WHEN kind_sel = 2 AND user_id % 3 = 0 THEN 2 ELSE n_boxes END AS INTEGER) AS boxes,
        CASE WHEN kind_sel = 2 AND user_id % 3 = 0 THEN 30.0::DOUBLE END AS page_x_sum FROM fb WHERE {_ALIVE} AND user_id % 4 <> 0""",
    ),
)
def legacy_box_backfill(spark: SparkSession, root: str) -> DataFrame:
    boxes = F.col("prediction_boxes")
    from_page = F.col("correction_kind").eqNullSafe("sequence") & F.exists(boxes, lambda b: b["bbox"]["height"] == 20.0)
    total = F.aggregate(boxes, F.lit(0.0), lambda acc, b: acc + b["bbox"]["x"])
    return complete_corrections(spark, root).select(
        "event_id", F.when(boxes.isNull(), 0).otherwise(F.size(boxes)).alias("boxes"), F.when(from_page, total).alias("page_x_sum")
    )


@query(
    "j02_training_items",
    with_ctes(
        ["items"],
        """SELECT event_id, CAST(item_index AS INTEGER) AS item_index, label,
        CAST(CASE WHEN boxes = 'page' THEN item_index * 10 ELSE round_even(k * 1.5::DOUBLE, 0) END AS INTEGER) AS x0,
        CAST(CASE WHEN boxes = 'page' THEN 5 ELSE round_even(event_id % 100 + 0.5::DOUBLE, 0) END AS INTEGER) AS y0,
        CAST(CASE WHEN boxes = 'page' THEN 8 ELSE greatest(1, k % 13) END AS INTEGER) AS width,
        CAST(CASE WHEN boxes = 'page' THEN 20 ELSE round_even(10.5::DOUBLE, 0) END AS INTEGER) AS height
        FROM items WHERE ch1 <> chr(92) AND ch2 <> chr(92)""",
    ),
)
def training_items(spark: SparkSession, root: str) -> DataFrame:
    items = B.training_items(complete_corrections(spark, root), L.CHARACTER_LABELS)
    return items.select("event_id", "item_index", "label", "x0", "y0", "width", "height")


_COUNTS = """, vocab AS (SELECT * FROM (VALUES ('character', 0, '^[^\\\\]$'), ('folded_alnum', 1, '^[0-9A-Z]$'), ('mixedcase', 2, '^[0-9A-Za-z]$')) v(recognizer, pos, re)),
    counts AS (SELECT recognizer, label, count(*) AS count FROM items, vocab
      WHERE regexp_matches(ch1, re) AND (ch2 = '' OR regexp_matches(ch2, re)) GROUP BY 1, 2)"""
_PRIORITY = f""", prio AS (SELECT recognizer, pos, ch AS label, row_number() OVER (PARTITION BY recognizer ORDER BY min(i)) - 1 AS rank FROM (
      SELECT recognizer, pos, i, CASE WHEN recognizer = 'folded_alnum' THEN upper(ch) ELSE ch END AS ch, re FROM vocab, (
        SELECT substr('{L.PRIORITY_LABELS.replace("'", "''")}', CAST(i AS INTEGER), 1) AS ch, i FROM range(1, {len(L.PRIORITY_LABELS) + 1}) r(i)))
      WHERE recognizer = 'character' OR regexp_matches(ch, re) GROUP BY recognizer, pos, ch),
    rws AS (SELECT p.recognizer, p.pos, p.label, p.rank, coalesce(c.count, 0) AS count FROM prio p LEFT JOIN counts c USING (recognizer, label)),
    cov AS (SELECT *, greatest({{t}} - count, 0) AS needed, count >= {{t}} AS ready FROM rws),
    que AS (SELECT *, row_number() OVER (PARTITION BY recognizer ORDER BY needed DESC, count, rank) AS qr FROM cov WHERE NOT ready)"""


def _report(body: str, target: int) -> str:
    sql = with_ctes(["items"], _COUNTS + _PRIORITY.replace("{t}", str(target)) + "\n" + body)
    return sql.replace("\n, vocab AS", ",\nvocab AS")


def coverage(spark: SparkSession, root: str, target: int) -> DataFrame:
    priority = B.priority_table(spark, B.default_recognizers())
    return B.coverage_rows(recognizer_counts(spark, root), priority, target)


# A target near the middle of the counts, so that some labels are ready and some are not.
TARGET = 80


@query("a11_label_counts", _report("SELECT recognizer, label, count FROM counts", TARGET))
def label_counts(spark: SparkSession, root: str) -> DataFrame:
    return recognizer_counts(spark, root)


@query(
    "p05_priority_coverage",
    _report("SELECT recognizer, string_agg(label || ':' || count, ', ' ORDER BY rank) AS coverage FROM cov GROUP BY 1", TARGET),
)
def priority_coverage(spark: SparkSession, root: str) -> DataFrame:
    return B.priority_coverage_text(coverage(spark, root, TARGET))


@query(
    "v08_collection_queue",
    _report(
        """SELECT recognizer, label, count, needed, CAST(qr AS INTEGER) AS queue_rank, round(100.0::DOUBLE * count / 80, 6) AS coverage_percent
        FROM que WHERE qr <= 8""",
        TARGET,
    ),
)
def collection_queue(spark: SparkSession, root: str) -> DataFrame:
    queue = B.collection_queue(coverage(spark, root, TARGET), 8, TARGET)
    return queue.select("recognizer", "label", "count", "needed", "queue_rank", rounded("coverage_percent").alias("coverage_percent"))


_SUMMARY = """SELECT recognizer, count(*) FILTER (ready) = count(*) AS ready, count(*) FILTER (ready) AS ready_labels, count(*) AS total_labels,
    count(*) FILTER (NOT ready) AS not_ready_labels, CAST(sum(count) AS BIGINT) AS samples, count(*) * {t} AS target_samples,
    CAST(greatest(count(*) * {t} - sum(count), 0) AS BIGINT) AS needed_samples, round(100.0::DOUBLE * sum(count) / (count(*) * {t}), 6) AS coverage_percent
    FROM cov GROUP BY recognizer"""


@query("a13_readiness_summary", _report(_SUMMARY.replace("{t}", str(TARGET)), TARGET))
def readiness_summary(spark: SparkSession, root: str) -> DataFrame:
    out = B.readiness_summary(coverage(spark, root, TARGET), TARGET)
    return out.drop("recognizer_pos").withColumn("coverage_percent", rounded("coverage_percent"))


@query(
    "a12_coverage_report",
    _report(
        """, tot AS (SELECT recognizer, count(*) FILTER (ready) AS ready_labels, count(*) AS total_labels, CAST(sum(count) AS BIGINT) AS samples,
          CAST(sum(needed) AS BIGINT) AS needed_samples FROM cov GROUP BY 1),
        foc AS (SELECT recognizer, string_agg(label, '' ORDER BY qr) FILTER (qr <= 8) AS focus_labels, string_agg(label, '' ORDER BY qr) AS not_ready,
          CAST(sum(count) FILTER (qr <= 8) AS BIGINT) AS fs, CAST(sum(needed) FILTER (qr <= 8) AS BIGINT) AS fn,
          max(label) FILTER (qr = 1) AS next_label, max(count) FILTER (qr = 1) AS nc, max(needed) FILTER (qr = 1) AS nn FROM que GROUP BY 1)
        SELECT recognizer, ready_labels = total_labels AS ready,
        CASE WHEN ready_labels = total_labels THEN 'train_corrections' ELSE 'collect_corrections' END AS recommended_action,
        CASE WHEN ready_labels = total_labels THEN '' ELSE 'Need ' || needed_samples || ' more labeled samples across ' || (total_labels - ready_labels) || ' labels before training.' END AS training_blocked_reason,
        ready_labels, total_labels, total_labels - ready_labels AS not_ready_labels, samples, total_labels * 80 AS target_samples, needed_samples,
        round(100.0::DOUBLE * samples / (total_labels * 80), 6) AS coverage_percent, next_label, coalesce(nc, 0) AS next_count, coalesce(nn, 0) AS next_needed,
        CAST(CASE WHEN next_label IS NULL THEN 0 ELSE 80 END AS INTEGER) AS next_target,
        CASE WHEN next_label IS NULL THEN 100.0 ELSE round(100.0::DOUBLE * nc / 80, 6) END::DOUBLE AS next_coverage_percent,
        CAST(length(coalesce(focus_labels, '')) AS INTEGER) AS recommended_batch_size,
        coalesce(fs, 0) AS focus_samples, coalesce(fs, 0) + coalesce(fn, 0) AS focus_target_samples, coalesce(fn, 0) AS focus_needed_samples,
        CASE WHEN coalesce(fs, 0) + coalesce(fn, 0) > 0 THEN round(100.0::DOUBLE * fs / (fs + fn), 6) ELSE 100.0 END::DOUBLE AS focus_coverage_percent,
        coalesce(focus_labels, '') AS focus_labels, coalesce(not_ready, '') AS not_ready_label_list FROM tot LEFT JOIN foc USING (recognizer)""",
        TARGET,
    ).replace("\n, tot AS", ",\ntot AS"),
)
def coverage_report(spark: SparkSession, root: str) -> DataFrame:
    out = B.coverage_report(coverage(spark, root, TARGET), TARGET).drop("recognizer_pos")
    return out.withColumns(
        {
            "coverage_percent": rounded("coverage_percent"), "next_coverage_percent": rounded("next_coverage_percent"),
            "focus_coverage_percent": rounded("focus_coverage_percent"),
            "focus_labels": F.array_join("focus_labels", ""), "not_ready_label_list": F.array_join("not_ready_label_list", ""),
        }
    )


_ITEM_COUNTS = """, ic AS (SELECT recognizer, CAST(coalesce(sum(count), 0) AS BIGINT) AS items FROM vocab LEFT JOIN counts USING (recognizer) GROUP BY 1)"""


def item_counts(spark: SparkSession, root: str) -> DataFrame:
    return recognizer_counts(spark, root).groupBy("recognizer").agg(F.sum("count").alias("items"))


@query(
    "a14_readiness_rollup",
    _report(
        _ITEM_COUNTS
        + """, s AS (SELECT recognizer, any_value(pos) AS pos, bool_and(ready) AS ready, count(*) FILTER (NOT ready) AS nr, greatest(count(*) * 80 - sum(count), 0) AS need FROM cov GROUP BY 1),
        b AS (SELECT coalesce(string_agg(label, '' ORDER BY qr), '') AS batch_labels, count(*) AS batch_size, coalesce(CAST(sum(count) AS BIGINT), 0) AS bs, coalesce(CAST(sum(needed) AS BIGINT), 0) AS bn FROM que WHERE pos = 0 AND qr <= 8)
        SELECT (SELECT items FROM ic WHERE recognizer = 'character') AS character_crops, (SELECT items FROM ic WHERE recognizer = 'folded_alnum') AS folded_items,
        (SELECT items FROM ic WHERE recognizer = 'mixedcase') AS mixedcase_items, (SELECT bool_and(ready) FROM s) AS ready,
        CASE WHEN (SELECT bool_and(ready) FROM s) THEN 'train_corrections' ELSE 'collect_corrections' END AS recommended_action,
        (SELECT label FROM que WHERE qr = 1 ORDER BY pos LIMIT 1) AS recommended_label, batch_labels, batch_size,
        (SELECT nr FROM s WHERE pos = 0) AS not_ready_label_count, bs AS batch_samples, batch_size * 80 AS batch_target_samples, bn AS batch_needed_samples,
        CASE WHEN batch_size = 0 THEN 100.0 ELSE round(100.0::DOUBLE * bs / (batch_size * 80), 6) END::DOUBLE AS batch_coverage_percent,
        CASE WHEN (SELECT bool_and(ready) FROM s) THEN '' ELSE 'Need ' || (SELECT CAST(need AS BIGINT) FROM s WHERE pos = 0) || ' more labeled samples across '
          || (SELECT nr FROM s WHERE pos = 0) || ' labels before training.' END AS training_blocked_reason FROM b""",
        TARGET,
    ).replace("\n, ic AS", ",\nic AS"),
)
def readiness_rollup(spark: SparkSession, root: str) -> DataFrame:
    counts = cut_lineage(recognizer_counts(spark, root))
    rows = B.coverage_rows(counts, B.priority_table(spark, B.default_recognizers()), TARGET)
    out = B.readiness_rollup(rows, counts.groupBy("recognizer").agg(F.sum("count").alias("items")), TARGET)
    return out.withColumn("batch_coverage_percent", rounded("batch_coverage_percent"))


@query(
    "a15_training_trigger",
    _report(
        _ITEM_COUNTS + """ SELECT recognizer, items, CASE WHEN items = 0 THEN 'skip' WHEN items < 4000 THEN 'wait' ELSE 'train' END AS decision FROM ic""",
        TARGET,
    ).replace("\n, ic AS", ",\nic AS"),
)
def training_trigger(spark: SparkSession, root: str) -> DataFrame:
    return B.training_trigger(item_counts(spark, root), minimum=4000)


# ------------------------------------------------------------------ forms


@query(
    "p18_form_decode",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'second file.png' ELSE 'first.png' END AS filename,
    event_id % 11 <> 10 AS form_ok, CASE event_id % 11 WHEN 1 THEN ' ' WHEN 2 THEN 'AB' WHEN 6 THEN 'x' || chr(10) || 'y' WHEN 7 THEN 'xyz'
      WHEN 8 THEN 's' WHEN 9 THEN '~' ELSE 'A' END AS corrected_label,
    '{"x":1.5,"y":2,"width":3,"height":4,"row":1}' AS bbox FROM events""",
)
def form_decode(spark: SparkSession, root: str) -> DataFrame:
    return B.decode_forms(T.form_bodies(spark, root)).select("event_id", "filename", "form_ok", "corrected_label", "bbox")


@query(
    "p17_feedback_validation",
    """SELECT event_id, CASE event_id % 11 WHEN 5 THEN 'poem' WHEN 6 THEN 'sequence' WHEN 7 THEN 'sequence' ELSE 'character' END AS correction_kind,
    CASE event_id % 11 WHEN 1 THEN '' WHEN 2 THEN 'AB' WHEN 6 THEN 'xy' WHEN 7 THEN 'xyz' WHEN 8 THEN 's' WHEN 9 THEN '~' ELSE 'A' END AS corrected_label,
    CAST(CASE WHEN event_id % 11 IN (6, 7) THEN 2 ELSE 0 END AS INTEGER) AS boxes, 1.5::DOUBLE AS x,
    CASE WHEN event_id % 5 = 0 THEN 'second file.png' ELSE 'first.png' END AS filename,
    CASE event_id % 11 WHEN 1 THEN 'Type the correct character before saving.' WHEN 2 THEN 'Character corrections must be exactly one character.'
      WHEN 3 THEN 'Correction request is malformed.' WHEN 4 THEN 'Correction request is malformed.' WHEN 5 THEN 'Correction request is malformed.'
      WHEN 7 THEN 'Whole-result corrections must match the detected character count.'
      WHEN 8 THEN CASE WHEN event_id % 4 <> 0 THEN 'Practice correction is malformed.' END
      WHEN 9 THEN CASE WHEN event_id % 4 <> 0 THEN 'Practice correction is malformed.' ELSE 'Practice corrections must use a practice label.' END
      WHEN 10 THEN 'Correction request is malformed.' END AS reason, ts AS timestamp FROM events""",
)
def feedback_validation(spark: SparkSession, root: str) -> DataFrame:
    times = T.table(spark, root, "events").select("event_id", F.col("ts").alias(B.RECEIVED_AT))
    checked = B.validate_corrections(B.decode_forms(T.form_bodies(spark, root).join(times, "event_id")))
    return checked.select(
        "event_id", "correction_kind", "corrected_label", F.size("prediction_boxes").alias("boxes"), F.col("bbox.x").alias("x"),
        "filename", "reason", "timestamp",
    )


@query(
    "s12_practice_images",
    """SELECT 'practice-' || event_id AS image_id, 'image' || event_id AS content FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT 'practice-same', min('image' || event_id) FROM events WHERE event_id % 4 = 1 HAVING count(*) > 0""",
)
def practice_images(spark: SparkSession, root: str) -> DataFrame:
    """Forms in four kinds: an image of its own, a shared image id, a broken payload, a label that isn't practised."""

    kind = F.col("event_id") % 4
    payload = F.base64(F.encode(F.concat(F.lit("image"), "event_id"), "utf-8"))
    url = F.concat(F.lit(X.PNG_DATA_URL), F.when(kind == 2, "*").otherwise(""), payload)
    image = F.concat(F.lit("practice-"), F.when(kind == 1, "same").otherwise(F.col("event_id").cast("string")))
    label = F.when(kind == 3, "~").otherwise(B.PRIORITY_LABELS[0])
    box = '{"x": 1, "y": 2, "width": 3, "height": 4, "row": 1}'
    body = F.concat(
        F.lit("prediction_index=1&corrected_label="), F.url_encode(label), F.lit("&image_id="), image, F.lit("&bbox="), F.url_encode(F.lit(box)),
        F.lit("&source_image="), F.url_encode(url),
    )
    forms = B.decode_forms(T.spread(spark, root, "events").select(body.alias("body")), max_body=B.MAX_API_BODY * 1024)
    return B.practice_images(forms).select("image_id", F.decode("content", "utf-8").alias("content"))


@query(
    "p19_box_aligned_label",
    with_ctes(
        ["words"],
        """, w AS (SELECT page_id, row, substr(word, 1, 1) || chr(10) || substr(word, 2) AS display, translate(word, 'aeiou', 'AEIOU') AS original, word,
          CASE row % 3 WHEN 0 THEN length(word) WHEN 1 THEN length(word) + 1 ELSE 0 END AS boxes,
          CASE row % 4 WHEN 0 THEN word ELSE substr(word, 1, 1) || chr(10) || substr(word, 2) || CASE WHEN row % 4 = 1 THEN 'x' ELSE '' END END AS corrected FROM words)
        SELECT page_id, CAST(row AS INTEGER) AS row, CASE WHEN boxes = 0 THEN corrected
          WHEN row % 4 <> 1 AND length(original) = boxes THEN original WHEN length(replace(corrected, chr(10), '')) = boxes THEN replace(corrected, chr(10), '')
          ELSE corrected END AS label FROM w""",
    ).replace("\n, w AS", ",\nw AS"),
)
def box_aligned_label(spark: SparkSession, root: str) -> DataFrame:
    word, row = F.col("word"), F.col("row")
    display = F.concat(F.substring(word, 1, 1), F.lit("\n"), F.substr(word, F.lit(2)))
    size = F.length(word)
    boxes = F.when(row % 3 == 0, size).when(row % 3 == 1, size + 1).otherwise(0)
    corrected = F.when(row % 4 == 0, word).otherwise(F.concat(display, F.when(row % 4 == 1, "x").otherwise("")))
    return T.words(spark, root).select(
        "page_id", "row", X.box_aligned_label(corrected, F.translate(word, "aeiou", "AEIOU"), display, boxes).alias("label")
    )


@query(
    "p20_data_url_check",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Practice correction is missing its image id.'
      WHEN 2 THEN 'Practice correction image is malformed.' WHEN 3 THEN 'Practice correction image is malformed.'
      WHEN 5 THEN 'Practice correction image is malformed.' END AS reason FROM events""",
)
def data_url_check(spark: SparkSession, root: str) -> DataFrame:
    sel = F.col("event_id") % 6
    payload = F.base64(F.encode(F.concat(F.lit("image"), "event_id"), "utf-8"))
    source = (
        F.when(sel == 0, "").when(sel == 2, F.concat(F.lit("data:image/gif;base64,"), payload))
        .when(sel == 3, F.concat(F.lit(X.PNG_DATA_URL), F.lit("*"), payload))
        .when(sel == 5, F.concat(F.lit(X.PNG_DATA_URL), payload, F.lit("A")))
        .otherwise(F.concat(F.lit(X.PNG_DATA_URL), payload))
    )
    image = F.when(sel == 1, "").otherwise("practice-1")
    return T.table(spark, root, "events").select("event_id", X.data_url_reason(source, image).alias("reason"))


# ------------------------------------------------------------------ uploads


@query(
    "s12_upload_store",
    "SELECT DISTINCT sha256(text) AS image_id FROM conversations WHERE sha256(text) NOT IN (SELECT sha256(text) FROM conversations WHERE turn = 0)",
)
def upload_store(spark: SparkSession, root: str) -> DataFrame:
    uploads = T.table(spark, root, "conversations").select("turn", F.encode("text", "utf-8").alias("content"))
    store = feedback_log.upload_ids(uploads.filter("turn = 0"))
    return feedback_log.new_uploads(uploads, store).select("image_id")


_PARTS = """SELECT o_custkey AS request_id, o_orderkey AS part, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 2) AS BIGINT) END AS bytes,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 9000 + 10 AS INTEGER) END AS width, CAST(o_custkey % 8000 + 10 AS INTEGER) AS height FROM orders"""


@query(
    "s13_ingest_gate",
    f"""WITH p AS (SELECT * FROM ({_PARTS}) WHERE bytes > 0),
    t AS (SELECT request_id, count(*) AS f, sum(bytes) AS b FROM p GROUP BY 1),
    j AS (SELECT p.*, f, b, width::BIGINT * height AS px, sqrt(4000000.0::DOUBLE / (width::BIGINT * height)) AS sc FROM p JOIN t USING (request_id)),
    r AS (SELECT *, CASE WHEN b > 8388608 THEN 'Upload is too large.' WHEN f > 20 THEN 'Upload 20 or fewer files at a time.'
      WHEN px IS NULL THEN 'Could not read this as an image.' WHEN px > 60000000 THEN 'Image is too large. Use an image under 60 megapixels.' END AS reject_reason FROM j)
    SELECT request_id, part, reject_reason, CASE WHEN reject_reason IS NULL THEN CASE WHEN px <= 4000000 THEN width ELSE CAST(greatest(1, floor(width * sc)) AS INTEGER) END END AS page_width,
    CASE WHEN reject_reason IS NULL THEN CASE WHEN px <= 4000000 THEN height ELSE CAST(greatest(1, floor(height * sc)) AS INTEGER) END END AS page_height FROM r""",
)
def ingest_gate(spark: SparkSession, root: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    parts = T.table(spark, root, "orders").select(
        cust.alias("request_id"), key.alias("part"), F.when(key % 9 == 0, 0).otherwise(F.floor(F.col("o_totalprice") * 2)).alias("bytes"),
        F.when(key % 13 != 0, (key % 9000 + 10).cast("int")).alias("width"), (cust % 8000 + 10).cast("int").alias("height"),
    )
    return feedback_log.gate_uploads(parts).select("request_id", "part", "reject_reason", "page_width", "page_height")


@query(
    "s14_crop_extraction",
    with_ctes(
        ["items", "word_ink"],
        """, b AS (SELECT page_id, row_number() OVER () AS rn FROM (SELECT 1 AS page_id)),
        it AS (SELECT conv_id || '-' || turn AS page_id, conv_id * 10 + turn AS rec, length(text) AS n FROM conversations),
        bx AS (SELECT page_id, rec, i, CAST((rec % 7) * 8 + i * 11 AS INTEGER) AS x0, CAST((i - 1) * 5 AS INTEGER) AS y0, CAST(12 + rec % 40 AS INTEGER) AS w, CAST(4 + rec % 9 AS INTEGER) AS h
          FROM it, (VALUES (1), (2), (3)) v(i))
        SELECT CAST(65 + rec % 26 AS INTEGER) AS code, printf('%05d_%02d', rec, i) AS name, count(*) AS pixels, CAST(sum(y - y0) AS BIGINT) AS sum_y, CAST(sum(x - x0) AS BIGINT) AS sum_x
        FROM bx JOIN word_ink k ON k.page_id = bx.page_id AND x >= x0 AND x < x0 + bx.w AND y >= y0 AND y < y0 + bx.h GROUP BY 1, 2""",
    ).replace("\n, b AS (SELECT page_id, row_number() OVER () AS rn FROM (SELECT 1 AS page_id)),\n        it AS", ",\nit AS"),
)
def crop_extraction(spark: SparkSession, root: str) -> DataFrame:
    rec = F.col("conv_id") * 10 + F.col("turn")
    i = F.col("item_index")
    items = T.table(spark, root, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("image_id"), rec.alias("record_index"),
        F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("item_index"),
    ).select(
        "image_id", "record_index", "item_index", F.chr(65 + F.col("record_index") % 26).alias("label"),
        (F.col("record_index") % 7 * 8 + i * 11).cast("int").alias("x0"), ((i - 1) * 5).alias("y0"),
        (12 + F.col("record_index") % 40).cast("int").alias("width"), (4 + F.col("record_index") % 9).cast("int").alias("height"),
    )
    ink = T.word_ink(spark, root).withColumnRenamed("page_id", "image_id")
    return feedback_log.item_crops(items, ink).groupBy("code", "name").agg(
        F.count("*").alias("pixels"), F.sum("y").cast("long").alias("sum_y"), F.sum("x").cast("long").alias("sum_x")
    )


# ------------------------------------------------------------------ folders


@query(
    "s01_labelled_folders",
    """SELECT CAST(10 + p_partkey % 26 AS INTEGER) AS target, count(*) AS n FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1""",
)
def labelled_folders(spark: SparkSession, root: str) -> DataFrame:
    found = folders.labelled_folders(T.path_table(spark, root, "label"), L.vocabulary(spark, L.FOLDED_LABELS))
    return found.groupBy("target").agg(F.count("*").alias("n"))


@query(
    "s02_code_point_folders",
    """SELECT CAST(33 + p_partkey % 94 AS INTEGER) AS code, CAST(dense_rank() OVER (ORDER BY 33 + p_partkey % 94) - 1 AS INTEGER) AS target,
    count(*) FILTER (p_partkey % 7 <> 0) AS n FROM part GROUP BY 33 + p_partkey % 94 HAVING count(*) FILTER (p_partkey % 7 <> 0) > 0""",
)
def code_point_folders(spark: SparkSession, root: str) -> DataFrame:
    samples, _ = folders.base_code_samples(T.path_table(spark, root, "code"))
    return samples.groupBy(F.ascii("label").alias("code"), "target").agg(F.count("*").alias("n"))


@query(
    "s02_extra_code_folders",
    """SELECT CAST(CASE WHEN c BETWEEN 48 AND 57 THEN c - 48 WHEN c BETWEEN 65 AND 90 THEN c - 55 ELSE c - 61 END AS INTEGER) AS target, count(*) AS n
    FROM (SELECT 33 + p_partkey % 94 AS c FROM part WHERE p_partkey % 7 <> 0) WHERE c BETWEEN 48 AND 57 OR c BETWEEN 65 AND 90 OR c BETWEEN 97 AND 122 GROUP BY 1""",
)
def extra_code_folders(spark: SparkSession, root: str) -> DataFrame:
    samples, bad = folders.extra_code_samples(T.path_table(spark, root, "code"), L.vocabulary(spark, L.MIXED_LABELS))
    folders.require_code_folders(bad)
    return samples.groupBy("target").agg(F.count("*").alias("n"))


@query(
    "s03_hex_code_folders",
    """SELECT path, CAST(CASE WHEN c <= 57 THEN c - 48 WHEN c <= 90 THEN c - 55 ELSE c - 61 END AS INTEGER) AS target FROM (
    SELECT 'by_class/' || lower(to_hex(33 + p_partkey % 94)) || '/a/' || p_partkey || '.png' AS path, 33 + p_partkey % 94 AS c FROM part)
    WHERE c BETWEEN 48 AND 57 OR c BETWEEN 65 AND 90 OR c BETWEEN 97 AND 122
    QUALIFY row_number() OVER (PARTITION BY c ORDER BY md5('42|' || path), path) <= 15""",
)
def hex_code_folders(spark: SparkSession, root: str) -> DataFrame:
    return folders.balanced_hex_samples(T.path_table(spark, root, "hex"), 15, 42).select("path", "target")


@query(
    "s04_sample_folders",
    """SELECT CAST(CASE WHEN n >= 37 THEN n - 27 ELSE n - 1 END AS INTEGER) AS folded, CAST(n - 1 AS INTEGER) AS mixed, count(*) AS n
    FROM (SELECT p_partkey % 70 AS n FROM part) WHERE n BETWEEN 1 AND 62 GROUP BY n""",
)
def sample_folders(spark: SparkSession, root: str) -> DataFrame:
    paths = T.path_table(spark, root, "sample")
    folded = folders.numbered_samples(paths).withColumnRenamed("target", "folded")
    mixed = folders.numbered_samples(paths, fold_case=False).withColumnRenamed("target", "mixed")
    return folded.join(mixed, "path").groupBy("folded", "mixed").agg(F.count("*").alias("n"))


# The same layouts as real files: written, listed and read by the executors. A file holds its own relative path and number.


def _read_totals(found: DataFrame, *keys: str) -> DataFrame:
    sized = folders.read_files(found).withColumn("bytes", F.length("content").cast("long"))
    return sized.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(
    "s01_labelled_folder_scan",
    """SELECT CAST(10 + p_partkey % 26 AS INTEGER) AS target, count(*) AS n, CAST(sum(7 + 2 * strlen(CAST(p_partkey AS VARCHAR))) AS BIGINT) AS bytes
    FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1""",
)
def labelled_folder_scan(spark: SparkSession, root: str) -> DataFrame:
    # Class folders hold other files too, which are neither images nor opened.
    folder = T.written_folder(spark, root, "label")
    return _read_totals(folders.load_labelled_folder(spark, folder, L.vocabulary(spark, L.FOLDED_LABELS)), "target")


@query(
    "s02_code_folder_scan",
    """SELECT CAST(33 + p_partkey % 94 AS INTEGER) AS code, CAST(dense_rank() OVER (ORDER BY 33 + p_partkey % 94) - 1 AS INTEGER) AS target,
    count(*) FILTER (p_partkey % 7 <> 0) AS n,
    CAST(sum(6 + strlen(CAST(33 + p_partkey % 94 AS VARCHAR)) + 2 * strlen(CAST(p_partkey AS VARCHAR))) FILTER (p_partkey % 7 <> 0) AS BIGINT) AS bytes
    FROM part GROUP BY 33 + p_partkey % 94 HAVING count(*) FILTER (p_partkey % 7 <> 0) > 0""",
)
def code_folder_scan(spark: SparkSession, root: str) -> DataFrame:
    samples, _ = folders.base_code_samples(folders.list_in_tasks(spark, T.written_folder(spark, root, "code")))
    return _read_totals(samples, "label", "target").select(F.ascii("label").alias("code"), "target", "n", "bytes")


@query(
    "s03_hex_folder_scan",
    """SELECT rel, CAST(CASE WHEN c <= 57 THEN c - 48 WHEN c <= 90 THEN c - 55 ELSE c - 61 END AS INTEGER) AS target, md5(rel || '|' || p_partkey) AS digest FROM (
    SELECT 'by_class/' || lower(to_hex(33 + p_partkey % 94)) || '/a/' || p_partkey || '.png' AS rel, 33 + p_partkey % 94 AS c, p_partkey FROM part)
    WHERE c BETWEEN 48 AND 57 OR c BETWEEN 65 AND 90 OR c BETWEEN 97 AND 122
    QUALIFY row_number() OVER (PARTITION BY c ORDER BY md5('42|' || rel), rel) <= 15""",
)
def hex_folder_scan(spark: SparkSession, root: str) -> DataFrame:
    drawn = folders.load_hex_samples(spark, T.written_folder(spark, root, "hex"), 15, 42)
    return drawn.select("rel", "target", F.md5("content").alias("digest"))


@query(
    "s04_sample_folder_scan",
    """SELECT CAST(CASE WHEN n >= 37 THEN n - 27 ELSE n - 1 END AS INTEGER) AS target, count(*) AS n, CAST(sum(15 + 2 * strlen(CAST(p_partkey AS VARCHAR))) AS BIGINT) AS bytes
    FROM (SELECT p_partkey % 70 AS n, p_partkey FROM part) WHERE n BETWEEN 1 AND 62 GROUP BY 1""",
)
def sample_folder_scan(spark: SparkSession, root: str) -> DataFrame:
    listed = folders.list_in_tasks(spark, T.written_folder(spark, root, "sample"))
    return _read_totals(folders.numbered_samples(listed), "target")


@query(
    "s18_crop_folder_recount",
    """SELECT chr(CAST(33 + p_partkey % 94 AS INTEGER)) AS label, count(*) AS count FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1""",
)
def crop_folder_recount(spark: SparkSession, root: str) -> DataFrame:
    return folders.exported_crop_counts(folders.list_in_tasks(spark, T.written_folder(spark, root, "code")))


@query(
    "s07_manifest_subset",
    """SELECT mode, label, count(*) AS n FROM (
    SELECT 'alnum' AS mode, upper(chr(CAST(33 + p_partkey % 94 AS INTEGER))) AS label FROM part WHERE p_partkey % 5 <> 0 AND regexp_matches(chr(CAST(33 + p_partkey % 94 AS INTEGER)), '[0-9A-Za-z]')
    UNION ALL SELECT 'ascii', CAST(33 + p_partkey % 94 AS VARCHAR) FROM part WHERE p_partkey % 5 <> 0 AND regexp_matches(chr(CAST(33 + p_partkey % 94 AS INTEGER)), '[0-9A-Za-z+\\-/<>\\[\\]|]')) GROUP BY 1, 2""",
)
def manifest_subset(spark: SparkSession, root: str) -> DataFrame:
    code = 33 + F.col("p_partkey") % 94
    manifest = T.table(spark, root, "part").select(
        F.concat(F.lit("img/"), "p_partkey").alias("path"), F.when(F.col("p_partkey") % 5 == 0, r"\alpha").otherwise(F.chr(code)).alias("latex")
    )
    of = lambda mode: manifests.manifest_subset(manifest, mode).withColumn("mode", F.lit(mode))
    return of("alnum").unionByName(of("ascii")).groupBy("mode", "label").agg(F.count("*").alias("n"))


def stroke_files(spark: SparkSession, root: str) -> DataFrame:
    """One pen file per order in its customer's folder, a record each: well-formed, broken and foreign ones."""

    orders = T.table(spark, root, "orders")
    key = F.col("o_orderkey")
    word = F.concat(F.lit("WORD "), F.chr(48 + key % 75), F.lit(" trn_"), key, F.lit("\n"))
    header = F.when(key % 7 == 0, "  nothing\n").otherwise("  NUMSTROKES 2\n")
    first = F.concat(F.lit("  POINTS 2 # 10 20 "), (key % 50 + 11).cast("string"), F.lit(" "), (key % 70 + 21).cast("string"), F.lit("\n"))
    second = F.when(key % 5 == 0, "  oops\n").otherwise(F.concat(F.lit("  POINTS 1 # 10 "), (key % 90 + 20).cast("string"), F.lit("\n")))
    record = F.concat(F.lit("// comment\n"), word, header, first, second)
    path = F.concat_ws("/", F.col("o_custkey").cast("string"), F.lpad(key.cast("string"), 20, "0"))
    return orders.select(path.alias("path"), record.alias("value"))


_PENS = """SELECT o_custkey, o_orderkey AS k, chr(CAST(48 + o_orderkey % 75 AS INTEGER)) AS label FROM orders
    WHERE o_orderkey % 7 <> 0 AND regexp_matches(chr(CAST(48 + o_orderkey % 75 AS INTEGER)), '[0-9A-Za-z<>\\[\\]]')"""


@query(
    "s08_stroke_records",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS path, label, 'trn_' || k AS session, CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS strokes,
    CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 3 END AS INTEGER) AS points, CAST(k % 50 + 11 AS INTEGER) AS second_x FROM ({_PENS})""",
)
def stroke_records(spark: SparkSession, root: str) -> DataFrame:
    return strokes.parse_strokes(stroke_files(spark, root)).select(
        F.substring_index("path", "/", 1).alias("path"), "label", "session", F.size("strokes").alias("strokes"), F.size(F.flatten("strokes")).alias("points"),
        F.get(F.get("strokes", F.lit(0)), F.lit(1))["x"].alias("second_x"),
    )


@query(
    "s08_stroke_file_scan",
    f"""SELECT label, 'trn_' || k AS session, CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS strokes,
    CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 3 END AS INTEGER) AS points, CAST(k % 50 + 11 AS INTEGER) AS second_x FROM ({_PENS})""",
)
def stroke_file_scan(spark: SparkSession, root: str) -> DataFrame:
    """The same records in a few large files, read in as many splits as the text source makes."""

    folder = scratch_path(spark)
    tasks = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stroke_files(spark, root).select("value").repartition(tasks).write.text(folder)
    return strokes.parse_stroke_lines(strokes.read_stroke_lines(spark, folder)).select(
        "label", "session", F.size("strokes").alias("strokes"), F.size(F.flatten("strokes")).alias("points"),
        F.get(F.get("strokes", F.lit(0)), F.lit(1))["x"].alias("second_x"),
    )


@query(
    "s09_stroke_normalization",
    f"""WITH p AS (SELECT *, k % 50 + 1 AS dx, CASE WHEN k % 5 = 0 THEN k % 70 + 1 ELSE greatest(k % 70 + 1, k % 90) END AS dy FROM ({_PENS}))
    SELECT CAST(o_custkey AS VARCHAR) AS path, 'trn_' || k AS session,
    CAST(round_even((96 - dx * (76.0::DOUBLE / greatest(dx, dy))) / 2.0, 0) AS INTEGER) AS x_first,
    CAST(round_even(dx * (76.0::DOUBLE / greatest(dx, dy)) + (96 - dx * (76.0::DOUBLE / greatest(dx, dy))) / 2.0, 0) AS INTEGER) AS x_second,
    CAST(round_even((k % 70 + 1) * (76.0::DOUBLE / greatest(dx, dy)) + (96 - dy * (76.0::DOUBLE / greatest(dx, dy))) / 2.0, 0) AS INTEGER) AS y_second FROM p""",
)
def stroke_normalization(spark: SparkSession, root: str) -> DataFrame:
    parsed = strokes.parse_strokes(stroke_files(spark, root)).withColumn("s", strokes.normalize_strokes(F.col("strokes")))
    stroke = F.get("s", F.lit(0))
    return parsed.select(
        F.substring_index("path", "/", 1).alias("path"), "session", F.get(stroke, F.lit(0))["x"].alias("x_first"), F.get(stroke, F.lit(1))["x"].alias("x_second"),
        F.get(stroke, F.lit(1))["y"].alias("y_second"),
    )


@query(
    "v10_stroke_limit",
    f"SELECT label, 'trn_' || k AS session FROM ({_PENS}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY CAST(o_custkey AS VARCHAR), k) <= 3",
)
def stroke_limit(spark: SparkSession, root: str) -> DataFrame:
    return strokes.limit_per_label(strokes.parse_strokes(stroke_files(spark, root)), 3).select("label", "session")


@query(
    "s15_root_fingerprints",
    """SELECT conv_id, substr(sha1('[' || string_agg('"' || role || turn || '"', ',' ORDER BY turn) || ']'), 1, 12) AS fingerprint FROM conversations GROUP BY 1""",
)
def root_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    roots = T.table(spark, root, "conversations").select(
        "conv_id", F.col("turn").alias("position"), F.concat("role", F.col("turn").cast("string")).alias("root")
    )
    return manifests.root_fingerprints(roots, ["conv_id"])


@query(
    "s16_checksum_manifest",
    """SELECT CAST(page_id AS VARCHAR) AS filename, md5(html) AS found, CASE WHEN page_id % 10 = 0 THEN md5(url) ELSE md5(html) END AS expected
    FROM pages WHERE page_id % 10 = 0""",
)
def checksum_manifest(spark: SparkSession, root: str) -> DataFrame:
    pages = T.table(spark, root, "pages").withColumn("filename", F.col("page_id").cast("string"))
    files = pages.select("filename", F.encode("html", "utf-8").alias("content"))
    wrong = F.when(F.col("page_id") % 10 == 0, F.col("url")).otherwise(F.col("html"))
    return folders.checksum_errors(files, pages.select("filename", F.md5(wrong).alias("md5")))


@query(
    "s17_metric_files",
    with_ctes(
        ["history"],
        """SELECT model AS file, 'history' AS kind, CAST(epoch - 1 AS INTEGER) AS position, CAST(epoch AS VARCHAR) AS epoch FROM history
        UNION ALL SELECT model, 'best_checkpoint', 0, CAST(max(epoch) AS VARCHAR) FROM history WHERE model NOT LIKE '1%' AND model NOT LIKE '5%' GROUP BY model""",
    ).replace("FROM history\n        UNION", "FROM history WHERE model NOT LIKE '5%'\n        UNION"),
)
def metric_files(spark: SparkSession, root: str) -> DataFrame:
    epochs = F.array_sort(F.collect_list(F.struct("epoch", "test_accuracy")))
    files = T.metric_history(spark, root).groupBy("model").agg(epochs.alias("h"), F.max("epoch").alias("last"))
    as_object = F.to_json(F.struct(F.col("h").alias("history"), F.struct(F.col("last").alias("epoch")).alias("best_checkpoint")))
    value = F.when(F.col("model").startswith("1"), F.to_json("h")).when(F.col("model").startswith("5"), "{broken").otherwise(as_object)
    raw = files.select(F.col("model").alias("file"), value.alias("value"))
    return manifests.metric_candidates(raw).select("file", "kind", "position", F.col("metrics")["epoch"].alias("epoch"))


@query(
    "s18_crop_recount",
    """SELECT chr(CAST(33 + p_partkey % 94 AS INTEGER)) AS label, count(*) AS count FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1""",
)
def crop_recount(spark: SparkSession, root: str) -> DataFrame:
    return folders.exported_crop_counts(T.path_table(spark, root, "code"))


@query(
    "s19_vocabulary_json",
    """SELECT '[' || string_agg('"' || p_type || ' ' || p_size || '"', ',' ORDER BY first) || ']' AS value FROM (
    SELECT p_type, p_size, min(p_partkey) AS first FROM part GROUP BY 1, 2)""",
)
def vocabulary_json(spark: SparkSession, root: str) -> DataFrame:
    vocab = T.table(spark, root, "part").groupBy(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("label")).agg(
        F.min("p_partkey").alias("idx")
    )
    return manifests.vocabulary_json(vocab)
