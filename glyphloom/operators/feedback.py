"""User corrections: decode, validate, explode into training items, report coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions.labels import (
    FOLDED_LABELS,
    MIXED_LABELS,
    PRIORITY_LABELS,
    TARGET_PER_LABEL,
    characters,
)
from glyphloom.functions.text import box_aligned_label, data_url_bytes, data_url_reason, strip
from glyphloom.session import computed_once, cut_lineage

BOX = "struct<x:double,y:double,width:double,height:double,row:int>"
BOX_LIST = f"array<struct<original_label:string,bbox:{BOX}>>"
FORM_FIELDS = [
    "correction_kind", "corrected_label", "prediction_index", "confidence", "bbox",
    "prediction_boxes", "source_image", "image_id", "original_label", "display_sequence",
    "sequence", "filename",
]

# --- fixed values: messages and limits of a refused correction --------------------
MALFORMED = "Correction request is malformed."
EMPTY_LABEL = "Type the correct character before saving."
ONE_CHARACTER = "Character corrections must be exactly one character."
TOO_LONG = "Correction is too long."
PRACTICE_MALFORMED = "Practice correction is malformed."
PRACTICE_LABEL = "Practice corrections must use a practice label."
UNALIGNED = "Whole-result corrections must match the detected character count."
MAX_API_BODY = 16_384
MAX_FORM_BODY = 8 * 1024 * 1024 + 16_384
MAX_SEQUENCE = 255
RECEIVED_AT = "received_at"
MAX_BOXES = 255
MIN_CORRECTIONS = 10
FOCUS_SIZE = 8


# ------------------------------------------------------------------ decode, validate


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def form_pairs(body: Column) -> Column:
    """URL-encoded body to ``array<struct<key, value>>`` in order of appearance."""

    return F.transform(
        F.split(body, "&"),
        lambda part: F.struct(
            _decoded(F.substring_index(part, "=", 1)).alias("key"),
            F.when(
                part.contains("="), _decoded(F.substring(part, F.instr(part, "=") + 1, F.length(part)))
            ).alias("value"),
        ),
    )


def form_field(pairs: Column, name: str) -> Column:
    """Last value of a repeated key; blanks kept, null when the key is absent."""

    found = F.filter(pairs, lambda p: p["key"] == name)
    return F.get(found, F.size(found) - 1)["value"]


def decode_forms(
    df: DataFrame, body: str = "body", fields: list[str] = FORM_FIELDS, max_body: int = MAX_FORM_BODY
) -> DataFrame:
    """One column per form field.

    ``form_ok`` is false for an empty or too long body and where a pair has no ``=``.
    The form route takes an image with the body, the API route (MAX_API_BODY) does not.
    """

    length = F.octet_length(body)
    paired = computed_once(df, {"_pairs": form_pairs(F.col(body))})
    ok = (length > 0) & (length <= max_body) & F.forall("_pairs", lambda p: p["value"].isNotNull())
    found = {name: form_field(F.col("_pairs"), name) for name in fields}
    return computed_once(paired, {"form_ok": ok, **found}).drop("_pairs")


def _json_number(obj: Column, key: str, default: float) -> Column:
    """A numeric member; the default when absent, null when it cannot be read."""

    raw = F.get_json_object(obj, f"$.{key}")
    keys = F.coalesce(F.json_object_keys(obj), F.array().cast("array<string>"))
    return F.when(~F.array_contains(keys, key), F.lit(float(default))).otherwise(raw.try_cast("double"))


def _box_struct(obj: Column) -> Column:
    return F.struct(
        _json_number(obj, "x", 0).alias("x"),
        _json_number(obj, "y", 0).alias("y"),
        _json_number(obj, "width", 0).alias("width"),
        _json_number(obj, "height", 0).alias("height"),
        _json_number(obj, "row", 1).try_cast("int").alias("row"),
    )


def _box_complete(box: Column) -> Column:
    return (
        box["x"].isNotNull() & box["y"].isNotNull() & box["width"].isNotNull()
        & box["height"].isNotNull() & box["row"].isNotNull()
    )


def _clean_boxes(raw: Column) -> Column:
    """The usable entries of a JSON box list, first 255 looked at."""

    items = F.slice(F.from_json(raw, "array<string>"), 1, MAX_BOXES)
    objects = F.filter(items, lambda i: F.json_object_keys(i).isNotNull())

    def bbox_text(item: Column) -> Column:
        has = F.array_contains(F.json_object_keys(item), "bbox")
        return F.when(has, F.get_json_object(item, "$.bbox")).otherwise(F.lit("{}"))

    with_box = F.filter(objects, lambda i: F.json_object_keys(bbox_text(i)).isNotNull())
    shaped = F.transform(
        with_box,
        lambda i: F.struct(
            F.substring(F.coalesce(F.get_json_object(i, "$.original_label"), F.lit("")), 1, 16).alias(
                "original_label"
            ),
            _box_struct(bbox_text(i)).alias("bbox"),
        ),
    )
    return F.filter(shaped, lambda b: _box_complete(b["bbox"]))


def validate_corrections(forms: DataFrame, practice_labels: str = PRIORITY_LABELS) -> DataFrame:
    """Shape decoded forms into correction records with the first failing rule as ``reason``.

    ``reason`` is null on accepted rows. Splitting on it gives the log and the
    quarantine from one pass. A column ``received_at`` with the event's time becomes
    the record's ``timestamp``; without it the column is null.
    """

    def field(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    ok = F.col("form_ok") if "form_ok" in forms.columns else F.lit(True)
    kind0 = strip(field("correction_kind", "character"))
    shaped = computed_once(
        forms,
        {
            "_kind": F.when(kind0 == "", "character").otherwise(kind0),
            "_label": strip(field("corrected_label")),
            "_index": strip(field("prediction_index", "0")).try_cast("int"),
            "_conf": strip(field("confidence", "0")).try_cast("double"),
            "_bbox_text": field("bbox", "{}"),
            "_boxes_text": field("prediction_boxes", "[]"),
            "_display": F.coalesce("display_sequence", "sequence", F.lit("")),
        },
    )
    sequence = F.col("_kind") == "sequence"
    listed = F.json_array_length("_boxes_text").isNotNull()
    shaped = computed_once(
        shaped,
        {
            "_bbox_ok": F.json_object_keys("_bbox_text").isNotNull(),
            "_boxes_ok": listed,
            "_bbox": _box_struct(F.col("_bbox_text")),
            "_boxes": F.when(sequence & listed, _clean_boxes(F.col("_boxes_text"))).otherwise(F.array().cast(BOX_LIST)),
        },
    )
    aligned = box_aligned_label(F.col("_label"), field("original_label"), F.col("_display"), F.size("_boxes"))
    shaped = computed_once(shaped, {"_final": F.when(sequence, aligned).otherwise(F.col("_label"))})
    character = F.col("_kind") == "character"
    limit = F.when(sequence, MAX_SEQUENCE).otherwise(1)
    practice = field("source_image") != ""
    reason = (
        F.when(~ok, MALFORMED)
        .when(F.col("_label") == "", EMPTY_LABEL)
        .when((F.length("_label") > limit) & character, ONE_CHARACTER)
        .when(F.length("_label") > limit, TOO_LONG)
        .when(F.col("_index").isNull() | F.col("_conf").isNull(), MALFORMED)
        .when(~F.col("_bbox_ok") | ~F.col("_boxes_ok"), MALFORMED)
        .when(~F.col("_kind").isin("character", "sequence"), MALFORMED)
        .when(character & (F.col("_index") < 1), MALFORMED)
        .when(practice & (~character | ~field("image_id").startswith("practice-")), PRACTICE_MALFORMED)
        .when(practice & ~F.lit(practice_labels).contains(F.col("_label")), PRACTICE_LABEL)
        .when(sequence & (F.length("_final") != F.size("_boxes")), UNALIGNED)
        .when(~_box_complete(F.col("_bbox")), MALFORMED)
    )
    keep = [c for c in forms.columns if c not in FORM_FIELDS and c not in ("body", "form_ok", RECEIVED_AT)]
    received = F.col(RECEIVED_AT) if RECEIVED_AT in forms.columns else F.lit(None)
    return shaped.select(
        *keep,
        F.col("_kind").alias("correction_kind"),
        F.substring(field("filename"), 1, 255).alias("filename"),
        F.substring(field("image_id"), 1, 128).alias("image_id"),
        F.substring(field("sequence"), 1, 255).alias("sequence"),
        F.col("_index").alias("prediction_index"),
        F.substring(field("original_label"), F.lit(1), F.when(sequence, 255).otherwise(16)).alias("original_label"),
        F.col("_final").alias("corrected_label"),
        F.col("_conf").alias("confidence"),
        F.col("_bbox").alias("bbox"),
        F.col("_boxes").alias("prediction_boxes"),
        received.cast("timestamp").alias("timestamp"),
        reason.alias("reason"),
    )


def practice_images(forms: DataFrame) -> DataFrame:
    """(image_id, content): the image sent with each accepted practice form, first copy per image id by content.

    Forms that validation or the payload check refuses give none. The result feeds
    an anti-join on the ids that the store already holds.
    """

    checked = validate_corrections(forms.withColumn("_source", F.coalesce("source_image", F.lit(""))))
    accepted = checked.filter(F.col("reason").isNull() & (F.col("_source") != "") & data_url_reason(F.col("_source"), F.col("image_id")).isNull())
    decoded = accepted.select("image_id", data_url_bytes(F.col("_source")).alias("content"))
    return decoded.groupBy("image_id").agg(F.min("content").alias("content"))


# -------------------------------------------------------------- records to items


def with_source_image(corrections: DataFrame, uploads: DataFrame, image_id: str = "image_id") -> DataFrame:
    """Records whose source image is stored."""

    named = corrections.filter(F.coalesce(F.col(image_id), F.lit("")) != "")
    return named.join(uploads.select(image_id), image_id, "left_semi")


def replay_cases(corrections: DataFrame, uploads: DataFrame) -> DataFrame:
    """``(filename, image_id, target)`` of sequence corrections that can be replayed."""

    wanted = corrections.filter(
        (F.col("correction_kind") == "sequence") & (F.coalesce(F.col("corrected_label"), F.lit("")) != "")
    )
    return with_source_image(wanted, uploads).select(
        F.coalesce("filename", F.concat("image_id", F.lit(".png"))).alias("filename"),
        "image_id",
        F.col("corrected_label").alias("target"),
    )


def backfill_sequence_boxes(corrections: DataFrame, regions: DataFrame) -> DataFrame:
    """Give old sequence rows without boxes the page's regions, if the counts agree.

    ``regions``: image_id, row, x0, y0, x1, y1. Only pages of records that lack
    boxes, and whose region count is the length of one of their labels, are gathered;
    a page is bounded by the ingest limits.
    """

    lacking = (
        (F.col("correction_kind") == "sequence")
        & (F.coalesce(F.size("prediction_boxes"), F.lit(0)) <= 0)
        & (F.coalesce(F.col("corrected_label"), F.lit("")) != "")
    )
    wanted = corrections.filter(lacking).select("image_id", F.length("corrected_label").alias("_n")).distinct()
    sizes = regions.join(wanted.select("image_id").distinct(), "image_id", "left_semi").groupBy("image_id").agg(F.count("*").cast("int").alias("_n"))
    small = sizes.join(wanted, ["image_id", "_n"], "left_semi")
    pages = (
        regions.join(small, "image_id")
        .groupBy("image_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "row", "x0", "y0",
                        (F.col("x1") - F.col("x0")).alias("w"),
                        (F.col("y1") - F.col("y0")).alias("h"),
                    )
                )
            ).alias("_regions")
        )
    )
    boxes = F.transform(
        "_regions",
        lambda r: F.struct(
            F.lit("").alias("original_label"),
            F.struct(
                r["x0"].cast("double").alias("x"),
                r["y0"].cast("double").alias("y"),
                r["w"].cast("double").alias("width"),
                r["h"].cast("double").alias("height"),
                r["row"].cast("int").alias("row"),
            ).alias("bbox"),
        ),
    )
    fits = lacking & (F.size("_regions") == F.length("corrected_label"))
    return (
        corrections.join(pages, "image_id", "left")
        .withColumn("prediction_boxes", F.when(fits, boxes).otherwise(F.col("prediction_boxes")))
        .drop("_regions")
    )


def training_items(corrections: DataFrame, labels: list[str] | None) -> DataFrame:
    """One row per trainable glyph.

    A character record gives one item. A sequence gives one per (character, box),
    or none at all when the lengths differ or any label or box is unusable. A
    missing kind counts as character. Without ``labels`` any single character is usable.
    """

    one = lambda c: F.length(c) == 1
    in_vocab = one if labels is None else lambda c: one(c) & F.lit("".join(labels)).contains(c)
    kind = F.coalesce("correction_kind", F.lit("character"))
    text = F.coalesce("corrected_label", F.lit(""))
    chars = characters(text)
    boxes = F.coalesce("prediction_boxes", F.array().cast(BOX_LIST))
    item = "struct<label:string,bbox:" + BOX + ">"
    single = F.array(F.struct(text.alias("label"), F.col("bbox").alias("bbox")))
    paired = F.zip_with(chars, boxes, lambda c, b: F.struct(c.alias("label"), b["bbox"].alias("bbox")))
    none = F.array().cast(f"array<{item}>")
    items = (
        F.when((kind == "character") & in_vocab(text) & F.col("bbox").isNotNull(), single.cast(f"array<{item}>"))
        .when(
            (kind == "sequence")
            & (F.size(chars) == F.size(boxes))
            & F.forall(chars, in_vocab)
            & F.forall(boxes, lambda b: b["bbox"].isNotNull()),
            paired.cast(f"array<{item}>"),
        )
        .otherwise(none)
    )
    exploded = corrections.select("*", F.posexplode(items).alias("item_pos", "item"))
    box = F.col("item.bbox")
    return exploded.select(
        *[c for c in corrections.columns if c not in ("bbox", "prediction_boxes")],
        (F.col("item_pos") + 1).alias("item_index"),
        F.col("item.label").alias("label"),
        F.greatest(F.lit(0), F.bround(F.coalesce(box["x"], F.lit(0.0))).cast("int")).alias("x0"),
        F.greatest(F.lit(0), F.bround(F.coalesce(box["y"], F.lit(0.0))).cast("int")).alias("y0"),
        F.greatest(F.lit(1), F.bround(F.coalesce(box["width"], F.lit(0.0))).cast("int")).alias("width"),
        F.greatest(F.lit(1), F.bround(F.coalesce(box["height"], F.lit(0.0))).cast("int")).alias("height"),
    )


def recognizer_items(corrections: DataFrame, vocabularies: dict[str, list[str]]) -> DataFrame:
    """Items of several recognizers from one pass over the records, with ``recognizer``."""

    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit("".join(labels)).alias("chars")) for name, labels in vocabularies.items()]
    )
    # Which recognizers know all characters of a record; its items are made once and told apart last.
    text = characters(F.coalesce("corrected_label", F.lit("")))
    knowing = F.transform(F.filter(wanted, lambda v: F.forall(text, lambda c: v["chars"].contains(c))), lambda v: v["name"])
    return training_items(corrections.withColumn("_knowing", knowing), None).withColumn("recognizer", F.explode("_knowing")).drop("_knowing")


def label_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("label").agg(F.count("*").alias("count"))


# ------------------------------------------------------------------- reports


def priority_table(spark: SparkSession, recognizers: dict[str, str]) -> DataFrame:
    """``(recognizer, recognizer_pos, label, rank)`` of the labels each recognizer wants."""

    rows = [
        (name, pos, label, rank)
        for pos, (name, labels) in enumerate(recognizers.items())
        for rank, label in enumerate(dict.fromkeys(labels))
    ]
    return spark.createDataFrame(rows, "recognizer string, recognizer_pos int, label string, rank int")


def keep_priority(labels: str, allowed: list[str]) -> str:
    """Distinct priority labels that a recognizer knows, in order."""

    return "".join(label for label in dict.fromkeys(labels) if label in set(allowed))


def default_recognizers(priority: str = PRIORITY_LABELS) -> dict[str, str]:
    """Character, folded (upper-cased first) and mixed-case priority lists."""

    return {
        "character": priority,
        "folded_alnum": keep_priority(priority.upper(), FOLDED_LABELS),
        "mixedcase": keep_priority(priority, MIXED_LABELS),
    }


def coverage_rows(counts: DataFrame, priority: DataFrame, target: int = TARGET_PER_LABEL) -> DataFrame:
    """Count, need and readiness of every priority label, one recognizer at a time.

    ``counts`` holds (recognizer, label, count). The result has a row per priority
    label; it is written once, so that the reports, which read it several times, do
    not scan the corrections again.
    """

    joined = priority.join(counts, ["recognizer", "label"], "left")
    n = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    return cut_lineage(
        joined.select(
            "recognizer", "recognizer_pos", "label", "rank",
            n.alias("count"),
            F.greatest(F.lit(target) - n, F.lit(0)).alias("needed"),
            (n >= target).alias("ready"),
        )
    )


def collection_queue(rows: DataFrame, limit: int | None = FOCUS_SIZE, target: int = TARGET_PER_LABEL) -> DataFrame:
    """Labels still short of the target: most needed, then fewest samples, then priority."""

    order = W.partitionBy("recognizer").orderBy(F.desc("needed"), F.asc("count"), F.asc("rank"))
    queue = rows.filter(~F.col("ready")).withColumn("queue_rank", F.row_number().over(order))
    if limit is not None:
        queue = queue.filter(F.col("queue_rank") <= limit)
    return queue.withColumn("target", F.lit(target)).withColumn(
        "coverage_percent", 100.0 * F.col("count") / F.lit(target)
    )


def readiness_summary(rows: DataFrame, target: int = TARGET_PER_LABEL) -> DataFrame:
    """Totals per recognizer; the need is the shortfall of the total, not of each label."""

    total, samples = F.count("*"), F.sum("count")
    return rows.groupBy("recognizer", "recognizer_pos").agg(
        (F.count_if("ready") == total).alias("ready"),
        F.count_if("ready").alias("ready_labels"),
        total.alias("total_labels"),
        (total - F.count_if("ready")).alias("not_ready_labels"),
        samples.alias("samples"),
        (total * target).alias("target_samples"),
        F.greatest(total * target - samples, F.lit(0)).alias("needed_samples"),
        (100.0 * samples / (total * target)).alias("coverage_percent"),
    )


def _queue_list(limit: int | None = None) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("queue_rank", "label")))
    labels = F.transform(ordered, lambda q: q["label"])
    return F.slice(labels, 1, limit) if limit else labels


def coverage_report(rows: DataFrame, target: int = TARGET_PER_LABEL) -> DataFrame:
    """Per recognizer: totals, the focus batch of eight, the next label and what to do.

    Here the need adds up the gap of every label, and the coverage percent may
    pass 100 while labels are still missing.
    """

    queue = collection_queue(rows, None, target)
    focus = F.col("queue_rank") <= FOCUS_SIZE
    first = F.col("queue_rank") == 1
    queued = queue.groupBy("recognizer").agg(
        _queue_list(FOCUS_SIZE).alias("focus_labels"),
        _queue_list().alias("not_ready_label_list"),
        F.sum(F.when(focus, F.col("count"))).alias("focus_samples"),
        F.sum(F.when(focus, F.col("needed"))).alias("focus_needed_samples"),
        F.max(F.when(first, F.col("label"))).alias("next_label"),
        F.max(F.when(first, F.col("count"))).alias("next_count"),
        F.max(F.when(first, F.col("needed"))).alias("next_needed"),
    )
    totals = rows.groupBy("recognizer", "recognizer_pos").agg(
        F.count_if("ready").alias("ready_labels"),
        F.count("*").alias("total_labels"),
        F.sum("count").alias("samples"),
        F.sum("needed").alias("needed_samples"),
    )
    none = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = totals.join(queued, "recognizer", "left")
    ready = F.col("ready_labels") == F.col("total_labels")
    focus_target = zero("focus_samples") + zero("focus_needed_samples")
    return report.select(
        "recognizer", "recognizer_pos",
        ready.alias("ready"),
        F.when(ready, "train_corrections").otherwise("collect_corrections").alias("recommended_action"),
        F.when(ready, "")
        .otherwise(
            F.format_string(
                "Need %d more labeled samples across %d labels before training.",
                "needed_samples", F.col("total_labels") - F.col("ready_labels"),
            )
        )
        .alias("training_blocked_reason"),
        "ready_labels", "total_labels",
        (F.col("total_labels") - F.col("ready_labels")).alias("not_ready_labels"),
        "samples",
        (F.col("total_labels") * target).alias("target_samples"),
        "needed_samples",
        (100.0 * F.col("samples") / (F.col("total_labels") * target)).alias("coverage_percent"),
        "next_label",
        zero("next_count").alias("next_count"),
        zero("next_needed").alias("next_needed"),
        F.when(F.col("next_label").isNotNull(), target).otherwise(0).alias("next_target"),
        F.when(F.col("next_label").isNotNull(), 100.0 * F.col("next_count") / target)
        .otherwise(100.0)
        .alias("next_coverage_percent"),
        zero("focus_samples").alias("focus_samples"),
        focus_target.alias("focus_target_samples"),
        zero("focus_needed_samples").alias("focus_needed_samples"),
        F.when(focus_target > 0, 100.0 * zero("focus_samples") / focus_target)
        .otherwise(100.0)
        .alias("focus_coverage_percent"),
        F.coalesce("focus_labels", none).alias("focus_labels"),
        F.size(F.coalesce("focus_labels", none)).alias("recommended_batch_size"),
        F.coalesce("not_ready_label_list", none).alias("not_ready_label_list"),
    )


def readiness_rollup(rows: DataFrame, item_counts: DataFrame, target: int = TARGET_PER_LABEL) -> DataFrame:
    """One row over all recognizers: overall action, label to collect next, the first one's batch.

    ``item_counts``: recognizer, items. Train only when every recognizer is ready.
    """

    summary = readiness_summary(rows, target)
    queue = collection_queue(rows, FOCUS_SIZE, target)
    next_label = queue.filter("queue_rank = 1").select("recognizer", F.col("label").alias("next_label"))
    overall = (
        summary.join(next_label, "recognizer", "left")
        .join(item_counts, "recognizer", "left")
        .agg(
            F.bool_and("ready").alias("ready"),
            F.min_by("next_label", F.when(~F.col("ready") & F.col("next_label").isNotNull(), F.col("recognizer_pos")))
            .alias("recommended_label"),
            *[
                F.coalesce(F.max(F.when(F.col("recognizer") == r, F.col("items"))), F.lit(0)).alias(name)
                for r, name in (
                    ("character", "character_crops"),
                    ("folded_alnum", "folded_items"),
                    ("mixedcase", "mixedcase_items"),
                )
            ],
            F.max(F.when(F.col("recognizer_pos") == 0, F.col("needed_samples"))).alias("_need"),
            F.max(F.when(F.col("recognizer_pos") == 0, F.col("not_ready_labels"))).alias("not_ready_label_count"),
        )
    )
    batch = queue.filter("recognizer_pos = 0").agg(
        F.array_join(_queue_list(), "").alias("batch_labels"),
        F.count("*").alias("batch_size"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("batch_samples"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("batch_target_samples"),
        F.coalesce(F.sum("needed"), F.lit(0)).alias("batch_needed_samples"),
    )
    # Two one-row tables with different columns become one row.
    parts = overall.unionByName(batch, allowMissingColumns=True)
    both = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])
    return both.select(
        "character_crops", "folded_items", "mixedcase_items", "ready",
        F.when(F.col("ready"), "train_corrections").otherwise("collect_corrections").alias("recommended_action"),
        "recommended_label", "batch_labels", "batch_size", "not_ready_label_count",
        "batch_samples", "batch_target_samples", "batch_needed_samples",
        F.when(F.col("batch_target_samples") > 0, 100.0 * F.col("batch_samples") / F.col("batch_target_samples"))
        .otherwise(100.0)
        .alias("batch_coverage_percent"),
        F.when(F.col("ready"), "")
        .otherwise(
            F.format_string(
                "Need %d more labeled samples across %d labels before training.", "_need", "not_ready_label_count"
            )
        )
        .alias("training_blocked_reason"),
    )


def training_trigger(item_counts: DataFrame, minimum: int = MIN_CORRECTIONS, force: bool = False) -> DataFrame:
    """Skip without items, wait below the minimum unless forced, else train."""

    n = F.col("items")
    return item_counts.withColumn(
        "decision",
        F.when(n == 0, "skip").when((n < minimum) & F.lit(not force), "wait").otherwise("train"),
    )


def priority_coverage_text(rows: DataFrame) -> DataFrame:
    """``label:count`` of every priority label, in priority order, as one string."""

    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "label", F.col("count").cast("string")).alias("t"))))
    return rows.groupBy("recognizer").agg(F.array_join(F.transform(parts, lambda p: p["t"]), ", ").alias("coverage"))
