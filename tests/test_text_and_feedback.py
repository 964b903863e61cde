import json

import numpy as np
from pyspark.sql import functions as F

from glyphloom.functions import labels as L
from glyphloom.functions import text as X
from glyphloom.operators import feedback as B
from glyphloom.operators import marks, rows, routing, twins
from glyphloom.plans import page_layout
from glyphloom.plans import predictions_catalog  # noqa: F401
from glyphloom.plans import standins as T
from glyphloom.plans.registry import QUERIES
from glyphloom.sources import feedback_log

BOX = "%7B%22x%22%3A14%2C%22y%22%3A6%2C%22width%22%3A22%2C%22height%22%3A51%2C%22row%22%3A2%7D"
BOXES = "%5B" + "%2C".join(f"%7B%22original_label%22%3A%22{c}%22%2C%22bbox%22%3A%7B%22x%22%3A{i}%7D%7D" for i, c in enumerate("WVKM")) + "%5D"


def test_row_cleanup(spark):
    # Rows whose cleaned form has to come out as it does.
    cases = {
        "T3(e57": "T3(e5)", "Lab)": "(ab)", "T3L87": "T3L87", "7:5T": "Test", "7:5T9": "7:5T9", "T35T": "T35T",
        "p5": "15", "2T": "27", "HL!": "Hi!", "HL5": "HL5", "Hi'": "Hi.", "Hiy": "Hi.", "1A51": "1A51", "1851": "(85)",
        "caD7t": "caD7t", "cAnDt": "can't", "He110": "Hello", "xOO11eh'nd": "look behind", "": "", "(": "(", "H": "H",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, wanted string")
    out = X.clean_rows(df).collect()
    assert {r.text: r.cleaned for r in out} == cases
    assert all(bool(r.notes) == (r.text != r.cleaned) for r in out)


def test_page_cleanup(spark):
    data = [(1, 1, "HL"), (1, 2, ":"), (2, 1, "HL"), (2, 2, "7:5T"), (2, 3, "HL"), (3, 1, "abc")]
    out = {r.page_id: r for r in rows.clean_pages(spark.createDataFrame(data, "page_id int, row int, text string")).collect()}
    assert out[1].display == "Hi" and out[1].notes[-1] == X.NOTE_DROPPED
    assert out[2].display == "Hi\nTest\nHi"
    assert out[2].notes == [X.NOTE_GREETING, X.NOTE_TEST, "Kept 3 detected rows separated for reading."]
    assert out[3].display == "abc" and out[3].notes == []


def validated(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    return [r for r in B.validate_corrections(B.decode_forms(df)).orderBy("id").collect()]


def test_feedback_validation(spark):
    tail = f"&confidence=0.617&bbox={BOX}"
    out = validated(spark, [
        f"filename=desk-scan.png&sequence=Q9Zk2&prediction_index=5&original_label=C&corrected_label=%28{tail}",
        f"image_id=practice-abc&prediction_index=1&corrected_label=A{tail}&source_image=data",
        f"image_id=upload-abc&prediction_index=1&corrected_label=s{tail}&source_image=data",
        f"image_id=practice-abc&prediction_index=1&corrected_label=s{tail}&source_image=data",
        f"correction_kind=sequence&sequence=WVKM&display_sequence=WV%0AKM&original_label=WVKM&corrected_label=WT%0AKU&bbox=%7B%7D&prediction_boxes={BOXES}",
        f"correction_kind=sequence&sequence=WVKM&display_sequence=Hi+1&original_label=WVKM&corrected_label=Hi+1&bbox=%7B%7D&prediction_boxes={BOXES}",
        f"prediction_index=2&corrected_label=Hi{tail}",
        f"prediction_index=2&corrected_label=++{tail}",
        "prediction_index=2&corrected_label=A&bbox=%5B%5D",
        "prediction_index=2&corrected_label=A&bbox=%7B%22x%22%3A%22wide%22%7D",
        f"correction_kind=sequence&corrected_label=AB&bbox=%7B%7D&prediction_boxes={BOXES}",
        "prediction_index=2&corrected_label=A&oops",
        "prediction_index=2&corrected_label=B&corrected_label=A&bbox=%7B%7D",
        "correction_kind=sequence&corrected_label=" + "x" * 256 + "&bbox=%7B%7D",
    ])
    assert [r.reason for r in out] == [
        None, B.PRACTICE_LABEL, B.PRACTICE_MALFORMED, None, None, None, B.ONE_CHARACTER, B.EMPTY_LABEL, B.MALFORMED,
        B.MALFORMED, B.UNALIGNED, B.MALFORMED, None, B.TOO_LONG,
    ]
    first = out[0]
    assert (first.corrected_label, first.confidence, first.prediction_index) == ("(", 0.617, 5)
    assert first.bbox.asDict() == {"x": 14.0, "y": 6.0, "width": 22.0, "height": 51.0, "row": 2}
    assert out[4].corrected_label == "WTKU" and out[5].corrected_label == "WVKM" and out[12].corrected_label == "A"
    assert [b.bbox.x for b in out[4].prediction_boxes] == [0.0, 1.0, 2.0, 3.0]


def test_body_limits(spark):
    df = spark.createDataFrame([("a=" + "x" * 16_384,), ("",), ("a=1",)], "body string")
    flags = lambda **k: [r.form_ok for r in B.decode_forms(df, **k).collect()]
    assert flags(max_body=B.MAX_API_BODY) == [False, False, True]
    assert flags() == [True, False, True]


def test_log_round_trip(spark, tmp_path):
    out = B.validate_corrections(B.decode_forms(spark.createDataFrame(
        [(f"image_id=é1&prediction_index=1&corrected_label=%C3%A9&bbox={BOX}",), (f"image_id=b&prediction_index=1&corrected_label=b&bbox={BOX}",)], "body string")))
    path = str(tmp_path / "log")
    feedback_log.append_corrections(out.filter("reason is null").drop("reason"), path)
    spark.createDataFrame([("",), ("{broken",), ('{"corrected_label":"x"}',)], "value string").write.mode("append").text(path)
    lines = [r.value for r in spark.read.text(path).collect()]
    good = next(v for v in lines if "é1" in v)
    assert list(json.loads(good)) == sorted(json.loads(good)) and "é" in good
    assert {r.image_id for r in feedback_log.read_corrections(spark, path).collect()} == {"é1", "b"}


def items(spark, lines, labels=L.CHARACTER_LABELS):
    records = feedback_log.parse_corrections(spark.createDataFrame([(v,) for v in lines], "value string"))
    return sorted((r.label, r.x0, r.width) for r in B.training_items(records, labels).collect())


def test_training_items(spark):
    box = {"x": 2.5, "y": 1, "width": 0.2, "height": 9, "row": 1}
    seq = lambda text, n: {"image_id": "a", "correction_kind": "sequence", "corrected_label": text, "prediction_boxes": [{"original_label": "", "bbox": box}] * n}
    lines = [json.dumps(r) for r in (
        {"image_id": "a", "corrected_label": "Q", "bbox": box}, seq("Hi", 2), seq("Hi", 1), seq("H\\", 2),
        {"image_id": "a", "correction_kind": "other", "corrected_label": "Z", "bbox": box},
        {"image_id": "a", "correction_kind": "character", "corrected_label": "ab", "bbox": box},
    )]
    assert items(spark, lines) == [("H", 2, 1), ("Q", 2, 1), ("i", 2, 1)]
    assert items(spark, lines, L.FOLDED_LABELS) == [("Q", 2, 1)]


def coverage(spark, counts, labels, target=20):
    df = spark.createDataFrame([("character", k, v) for k, v in counts.items()], "recognizer string, label string, count long")
    return B.coverage_rows(df, B.priority_table(spark, {"character": labels}), target)


def test_readiness_and_queue(spark):
    out = B.readiness_summary(coverage(spark, {"A": 20, "B": 3}, "ABC")).first()
    assert (out.ready, out.ready_labels, out.total_labels, out.samples, out.needed_samples) == (False, 1, 3, 23, 37)
    assert abs(out.coverage_percent - 38.333333333333336) < 1e-9
    queue = B.collection_queue(coverage(spark, {"A": 19, "B": 0, "C": 5}, "ABC"), 2).orderBy("queue_rank").collect()
    assert [(r.label, r["count"], r.needed, r.coverage_percent) for r in queue] == [("B", 0, 20, 0.0), ("C", 5, 15, 25.0)]
    order = B.collection_queue(coverage(spark, {"A": 19, "B": 0, "C": 20, "D": 5}, "ABCD"), None).orderBy("queue_rank")
    assert [r.label for r in order.collect()] == ["B", "D", "A"]


def test_two_needs_differ_when_one_label_is_overfull(spark):
    rows_ = coverage(spark, {"A": 40}, "AB")
    assert B.coverage_report(rows_).first().needed_samples == 20
    summary = B.readiness_summary(rows_).first()
    assert summary.needed_samples == 0 and not summary.ready and summary.coverage_percent == 100.0


def test_report_when_all_is_ready(spark):
    out = B.coverage_report(coverage(spark, {"A": 20, "B": 25}, "AB")).first()
    assert (out.ready, out.recommended_action, out.training_blocked_reason, out.next_label) == (True, "train_corrections", "", None)
    assert out.focus_labels == [] and out.focus_coverage_percent == 100.0
    assert (out.next_target, out.next_coverage_percent, out.recommended_batch_size) == (0, 100.0, 0)


def test_digit_routing(spark):
    def preds(page, labels, confs, rows_=None):
        return [(page, (rows_ or [1] * len(labels))[i], i, c, f) for i, (c, f) in enumerate(zip(labels, confs))]

    schema = "page_id string, row int, idx int, shown string, confidence double"
    chars = preds("digits", "45J7", [.98, .97, .70, .96]) + preds("Hi", "Hi", [.98, .97]) + preds("mixed", "S0", [.7, .95])
    chars += preds("B7", "B7", [.91, .94]) + preds("rows", "4577", [.9] * 4, [1, 1, 2, 2])
    digits = preds("digits", "4557", [.99, .98, .97, .99]) + preds("Hi", "41", [.99, .98]) + preds("mixed", "50", [.99, .98])
    digits += preds("B7", "87", [.99, .98]) + preds("rows", "4577", [.99] * 4, [1, 1, 1, 2]) + preds("empty", "3", [.5])
    routed = routing.digit_pages(spark.createDataFrame(chars, schema), spark.createDataFrame(digits, schema))
    assert {r.page_id for r in routed.collect()} == {"digits", "empty"}


def test_priority_lists():
    assert B.keep_priority("sSO0O", L.FOLDED_LABELS) == "SO0"
    assert len(B.PRIORITY_LABELS) == 52
    assert [len(v) for v in B.default_recognizers().values()] == [52, 26, 42]


def test_ingest_gate(spark):
    data = [("a", f"f{i}", 10, 100, 100) for i in range(21)] + [
        ("b", "big", 9 * 1024 * 1024, 10, 10), ("c", "empty", 0, 10, 10), ("c", "ok", 5, 4000, 4000),
        ("c", "huge", 5, 10000, 6001), ("c", "bad", 5, None, None)]
    out = feedback_log.gate_uploads(spark.createDataFrame(data, "request_id string, filename string, bytes long, width int, height int"))
    got = {r.filename: (r.reject_reason, r.page_width, r.page_height) for r in out.collect()}
    assert got["f0"][0].startswith("Upload 20") and got["big"][0] == "Upload is too large." and "empty" not in got
    assert got["ok"] == (None, 2000, 2000) and "60 megapixels" in got["huge"][0] and got["bad"][0].startswith("Could not read")
    assert out.filter(F.col("request_id") == "a").count() == 21


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_form_is_split_once_however_often_its_fields_are_looked_at(spark):
    forms = B.decode_forms(spark.createDataFrame([("image_id=practice-1&corrected_label=A",)], "body string"))
    assert _optimized(B.practice_images(forms)).count("split(body") == 1


def test_word_spacing_is_worked_out_once_a_turn(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a bb\nccc")], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for df in (T.words(spark, str(tmp_path)), T.word_ink(spark, str(tmp_path))):
        above, below = _optimized(df).rsplit("Generate posexplode", 1)
        assert "array_max" not in above and "array_max" in below


def test_page_texts_writes_rows_and_no_glyphs(spark, monkeypatch):
    written = []
    cut = page_layout.cut_lineage
    monkeypatch.setattr(page_layout, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    glyph = ("p", 1, 1, "A", "A", 0.5, 0.0, 0.0, 10.0, 10.0, [("A", 0.5)])
    names = "page_id string, row int, idx int, label string, shown string, confidence double, x double, y double, width double, height double"
    glyphs = spark.createDataFrame([glyph], names + ", alternatives array<struct<label:string,confidence:double>>")
    assert [r.display for r in page_layout.page_texts(glyphs).collect()] == ["A"]
    assert written == [["page_id", "row", "text", "raw"]]


def test_long_rows_of_dots_are_met_in_portions(spark, monkeypatch):
    columns = {"x": np.arange(40.0), "y": np.where(np.arange(40) % 3 == 0, 0.0, 30.0)}
    sizes = {c: np.full(40, 10.0) for c in ("width", "height")}
    g = marks.Glyphs(np.arange(40) // 25, np.arange(40), np.zeros(40, int), {**columns, **sizes, "confidence": np.full(40, 0.1)}, [".", ":"])
    whole = marks._merged(g, marks.COLON)
    monkeypatch.setattr(marks, "PAIRS", 7)
    parts = marks._merged(g, marks.COLON)
    assert len(whole.at) < 40 and whole.at.tolist() == parts.at.tolist() and whole.label.tolist() == parts.label.tolist()


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_turns_are_dealt_and_their_glyphs_are_not(spark, tmp_path):
    """A glyph takes a hundred times the bytes of its character, so only whole turns may go through a shuffle."""

    turns = [(c, t, text) for c in range(4) for t in range(3) for text in ("Cc Ss5 l1i PP SsO", "kk 0O0")]
    turns += turns[:5] + [(None, 1, "Cc kk"), (2, None, "88"), (3, 1, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("v07_case_by_geometry", "j13_known_row_repair"):
        lines = _exchanges(QUERIES[name](spark, str(tmp_path)))
        assert len(lines) == 1 and "REPARTITION_BY_NUM" in lines[0]
    # Every glyph of a repeated key meets all of that key as they were.
    before = T.predictions(spark, str(tmp_path), "twins")
    after = twins.resolve_twins(before).selectExpr("page_id", "idx", "shown AS repaired", "confidence AS raised")
    want = before.join(after, ["page_id", "idx"]).filter("shown <> repaired OR confidence <> raised").selectExpr(
        "page_id", "row", "idx", "shown", "repaired", "round(raised, 6)")
    got = QUERIES["j13_known_row_repair"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_a_table_is_spread_over_tasks_by_its_size(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id", "uuid() AS text").write.parquet(str(tmp_path / "long.parquet"))
    few = T.spread(spark, str(tmp_path), "long").rdd.getNumPartitions()
    monkeypatch.setattr(T, "SPREAD_BYTES", 1024)
    assert few == 8 < T.spread(spark, str(tmp_path), "long", key=F.col("id") % 7).rdd.getNumPartitions()


def test_stretches_of_rows_give_the_rows_again(spark):
    """Texts that are empty, hold the separator, differ from the raw text or follow no row of their page."""

    data = [(p, r, t, raw) for p in ("a", "b") for r, t, raw in [
        (1, "Hi", "Hi"), (2, "", ""), (3, "x\x1fy", "x\x1fy"), (4, "ab", "ba"), (5, "c", "c"), (6, "d", "d"), (8, "e", "e"), (8, "e", "e"), (None, "f", "f"), (9, "g", "g")]]
    df = spark.createDataFrame(data, "page_id string, row int, text string, raw string").coalesce(1)
    held = rows.stretches(df)
    assert held.count() == 16 < len(data) and held.schema == df.schema
    for some in (held, rows.stretches(df.repartition(7)), rows.stretches(df.limit(0)).unionByName(held)):
        assert sorted(map(repr, rows.rows_of_stretches(some).collect())) == sorted(map(repr, df.collect()))


def test_page_texts_shuffles_turns_and_stretches_of_rows_only(spark, tmp_path, monkeypatch):
    turns = [(c, t, "Hi : l.1 Cc Ss5\n44 kk") for c in range(3) for t in range(2)] + [(1, 1, "Tes'"), (None, None, "Hi :"), (2, 9, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made = []
    cut = page_layout.cut_lineage
    monkeypatch.setattr(page_layout, "cut_lineage", lambda df: made.append(df) or cut(df))
    glyphs = T.predictions(spark, str(tmp_path))
    got = page_layout.page_texts(glyphs)
    lines = [line for df in (*made, got) for line in _exchanges(df)]
    assert len(lines) == 2 and all("REPARTITION" in line for line in lines)
    # The same as glyph by glyph.
    merged = marks.merge_marks(glyphs.select("page_id", "row", *page_layout.GLYPH_COLUMNS)).withColumn("shown", F.col("label"))
    plain = rows.row_texts(twins.resolve_twins(merged))
    want = rows.clean_pages(plain.select("page_id", "row", "text")).join(rows.joined_rows(plain), "page_id")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 7
