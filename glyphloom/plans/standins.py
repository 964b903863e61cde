"""Engine inputs derived from the given tables, for the registered queries.

The given tables hold no glyph images, so every input of an operator is derived
from their whole rows and whole texts. Each function has a matching DuckDB
common table expression in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.operators.curate import exemplar_bank, stratified_split
from glyphloom.operators.matching import nearest_exemplar
from glyphloom.session import cut_lineage, scratch_path
from glyphloom.sources.folders import write_files

TWIN_LABELS = ["0", "O", "o", "1", "l", "I", "S", "s", "5", "7"]
SCORE_LABELS = [chr(33 + i) for i in range(64)]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Letter by letter, the confusable glyph it is read as in the twin predictions.
CONFUSABLE = "opZiSGtOI4kzTs1P80l527M9yg"
READINGS = {"plain": (",", "'"), "twins": (LETTERS, CONFUSABLE), "marks": (",ht", "''.")}
CASE_AND_TWIN_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
CASE_AND_TWIN_TO = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZOlZzYSGTBg"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


# Bytes of a table for each task that expands its rows: what a task sorts must fit its memory, or it goes to disk.
SPREAD_BYTES = 256 * 1024
MOST_TASKS = 4000


def spread(spark: SparkSession, root: str, name: str, **keys: Column) -> DataFrame:
    """The table dealt anew by its first column, for inputs whose rows expand a lot.

    With ``keys`` these columns are added and the table is dealt by them. Spark knows that the rows made of it
    still lie by them, so that no group of such a key is shuffled again once its rows are many.
    """

    df = table(spark, root, name).withColumns(keys)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, size // SPREAD_BYTES))
    return df.repartition(tasks, *(keys or df.columns[:1]))


# ---------------------------------------------------------------- glyph samples


def glyph_samples(spark: SparkSession, root: str) -> DataFrame:
    labels = F.array(*[F.lit(label) for label in TWIN_LABELS])
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("label").alias("target"),
        F.get(labels, F.col("label")).alias("label"),
        F.concat(F.lit("src"), F.col("vec_id") % 3).alias("source"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def split_samples(spark: SparkSession, root: str) -> DataFrame:
    return stratified_split(glyph_samples(spark, root))


def scored_labels(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, batch_id, expected, predicted, distance): validation rows, 1-NN labels."""

    samples = cut_lineage(split_samples(spark, root))  # read twice below
    bank = exemplar_bank(samples.filter("split = 'train'"))
    queries = samples.filter("split = 'validation'").select("sample_id", F.col("label").alias("expected"), "vec")
    matched = nearest_exemplar(queries, bank, ["sample_id", "expected"])
    return matched.select(
        "sample_id", F.floor(F.col("sample_id") / 64).alias("batch_id"), "expected", "exemplar_id",
        F.col("exemplar_label").alias("predicted"), "distance",
    )


def score_vectors(spark: SparkSession, root: str, size: int) -> DataFrame:
    """(sample_id, target, scores): the first ``size`` numbers of a vector, times ten."""

    return spread(spark, root, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").alias("target"),
        F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, size), lambda v: v * 10).alias("scores"),
    )


# ---------------------------------------------------------------- predictions


def words(spark: SparkSession, root: str) -> DataFrame:
    """(conv_id, turn, page_id, row, word, places): every word of every turn; ``places`` is more than any word of the turn has characters."""

    split = F.split(F.translate("text", "\n", " "), " ")
    places = F.greatest(F.lit(100), F.array_max(F.transform(split, lambda w: F.length(w))) + 1)
    return (
        spread(spark, root, "conversations", page_id=F.concat_ws("-", "conv_id", "turn"))
        .select("conv_id", "turn", "page_id", places.alias("places"), split.alias("_words"))
        .select("conv_id", "turn", "page_id", "places", F.posexplode("_words").alias("_r", "word"))  # places once a turn, not a word
        .select("conv_id", "turn", "page_id", (F.col("_r") + 1).alias("row"), "word", "places")
        .filter("word <> ''")
    )


def _guess(label: Column, confidence: Column) -> Column:
    return F.struct(label.alias("label"), confidence.alias("confidence"))


def predictions(spark: SparkSession, root: str, reading: str = "plain") -> DataFrame:
    """One prediction per character of a word, whatever its script; a page is a turn, a row is a word.

    As ``twins`` each letter is read as a confusable glyph, as ``marks`` two frequent
    letters are read as loose dots, high and low.
    """

    chars = words(spark, root).select(
        "conv_id", "turn", "page_id", "row", "places", F.posexplode(F.split("word", "")).alias("_p", "ch")
    ).withColumn("pos", F.col("_p") + 1)
    code = F.ascii("ch")
    label = F.translate("ch", *READINGS[reading])
    stem = F.col("label").isin("l", "I", "1", "|", "!")
    dot = F.col("label").isin("i", ".", "'", ":")
    tall = F.col("label").between("A", "Z") | F.col("label").between("0", "9")  # of one character
    out = chars.withColumn("label", label).withColumns(
        {
            "idx": F.col("row") * F.col("places") + F.col("pos"),
            "x": F.col("pos") * 12.0,
            "height": F.when(stem, 56.0).when(dot, 10.0).when(tall, 60.0).otherwise(36.0),
            "width": F.when(stem, 8.0 + code % 12).when(dot, 10.0).otherwise(8.0 + code % 24),
            "confidence": (
                (F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("row") * 17 + F.col("pos") * 13) % 1000
            ) / F.lit(1000.0),
        }
    )
    y = (
        F.when(stem, 100.0).when(F.col("label").isin("i", "'"), 70.0).when(F.col("label") == ".", 158.0)
        .when(F.col("label") == ":", 120.0).otherwise(160.0 - F.col("height"))
    )
    second = F.translate("label", CASE_AND_TWIN_FROM, CASE_AND_TWIN_TO)
    return out.withColumn("y", y).withColumn(
        "alternatives",
        F.array(
            _guess(F.col("label"), F.col("confidence")),
            _guess(second, ((F.col("row") * 29 + F.col("pos") * 41 + F.col("turn")) % 600) / F.lit(1000.0)),
            _guess(
                F.chr(33 + (code + F.col("row")) % 94), ((F.col("row") * 3 + F.col("pos") * 5) % 400) / F.lit(1000.0)
            ),
        ),
    ).select(
        "page_id", "conv_id", "turn", "row", "pos", "idx", "label", F.col("label").alias("shown"), "confidence",
        "x", "y", "width", "height", "alternatives",
    )


# ---------------------------------------------------------------- text rows

PATTERN_ROWS = [
    "Hl", "H1!", "h|", "HLx", "Hi'", "hi`", "Hiy", "Hi:", "CAn'7", "canDt", "cant", "Heiio", "You", "you", "7o4",
    "Test", "7:5T", "Tes", "p5", "2T", "P5x", "1857", "[42]", "l12I", "1a2l", "(85]", "(85", "85)", "[85)", "L(8)1",
    "Hi", ":", "",
]


def text_rows(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, row, text): two pattern rows, then every line of the document."""

    patterns = F.array(*[F.lit(p) for p in PATTERN_ROWS])
    size = len(PATTERN_ROWS)
    lines = F.split("text", "\n")
    rows = F.concat(
        F.array(
            F.get(patterns, (F.col("doc_id") % size).cast("int")),
            F.get(patterns, ((F.col("doc_id") + F.floor(F.col("doc_id") / size)) % size).cast("int")),
        ),
        lines,
    )
    return spread(spark, root, "documents").select(
        F.col("doc_id").alias("page_id"), F.posexplode(rows).alias("_r", "text")
    ).select("page_id", (F.col("_r") + 1).alias("row"), "text")


# ---------------------------------------------------------------- feedback


def feedback_events(spark: SparkSession, root: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return (
        spread(spark, root, "events")
        .select("event_id", "user_id", F.col("user_id").cast("string").alias("uid"), k.alias("k"))
        .withColumn("kind_sel", F.col("event_id") % 6)
        .withColumn("c1", F.chr(33 + F.col("k") % 94))
        .withColumn("c2", F.chr(33 + (F.col("k") * 7 + F.col("event_id")) % 94))
        .withColumn("two", F.col("kind_sel").isin(0, 2))
        .withColumn(
            "n_boxes",
            F.when(F.col("kind_sel") == 0, F.when(F.col("event_id") % 12 == 0, 1).otherwise(2)).otherwise(0),
        )
    )


def correction_lines(spark: SparkSession, root: str) -> DataFrame:
    """(event_id, value): a JSONL log; every 50th line is cut short, some lack an image or a kind."""

    fb = feedback_events(spark, root)
    box = F.struct(
        (F.col("k") * 1.5).alias("x"), (F.col("event_id") % 100 + 0.5).alias("y"),
        (F.col("k") % 13).cast("double").alias("width"), F.lit(10.5).alias("height"), F.lit(1).alias("row"),
    )
    boxes = F.slice(F.array(*[F.struct(F.lit("").alias("original_label"), box.alias("bbox"))] * 2), F.lit(1), F.col("n_boxes"))
    record = F.struct(
        F.when(F.col("kind_sel") == 1, F.lit(None)).when(F.col("two"), "sequence").otherwise("character").alias("correction_kind"),
        F.concat(F.lit("f"), "event_id", F.lit(".png")).alias("filename"),
        F.when(F.col("event_id") % 40 == 7, "").otherwise(F.col("uid")).alias("image_id"),
        F.when(F.col("two"), F.concat("c1", "c2")).otherwise(F.col("c1")).alias("corrected_label"),
        box.alias("bbox"),
        F.when(F.col("n_boxes") > 0, boxes).alias("prediction_boxes"),
    )
    line = F.to_json(record)
    return fb.select("event_id", F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 5)).otherwise(line).alias("value"))


def stored_images(spark: SparkSession, root: str) -> DataFrame:
    return (
        table(spark, root, "events").filter("user_id % 4 <> 0")
        .select(F.col("user_id").cast("string").alias("image_id")).distinct()
    )


def page_regions(spark: SparkSession, root: str) -> DataFrame:
    """(image_id, row, x0, y0, x1, y1): two or three boxes per user."""

    n = F.when(F.col("user_id") % 3 == 0, 2).otherwise(3)
    return (
        table(spark, root, "events").select("user_id").distinct()
        .withColumn("i", F.explode(F.sequence(F.lit(1), n)))
        .select(
            F.col("user_id").cast("string").alias("image_id"), F.lit(1).alias("row"),
            (F.col("i") * 10).alias("x0"), F.lit(5).alias("y0"), (F.col("i") * 10 + 8).alias("x1"), F.lit(25).alias("y1"),
        )
    )


_BBOX = "%7B%22x%22%3A1.5%2C%22y%22%3A2%2C%22width%22%3A3%2C%22height%22%3A4%2C%22row%22%3A1%7D"
_TWO_BOXES = (
    "%5B%7B%22original_label%22%3A%22a%22%2C%22bbox%22%3A" + _BBOX + "%7D%2C"
    "%7B%22original_label%22%3A%22b%22%2C%22bbox%22%3A" + _BBOX + "%7D%5D"
)
FORM_TAILS = [
    ("character", "corrected_label=A&prediction_index=1"),
    ("character", "corrected_label=+&prediction_index=1"),
    ("character", "corrected_label=AB&prediction_index=1"),
    ("character", "corrected_label=A&prediction_index=abc"),
    ("character", "corrected_label=A&prediction_index=0"),
    ("poem", "corrected_label=A&prediction_index=1"),
    ("sequence", "corrected_label=x%0Ay&prediction_index=0&prediction_boxes=" + _TWO_BOXES),
    ("sequence", "corrected_label=xyz&prediction_index=0&prediction_boxes=" + _TWO_BOXES),
    ("character", "corrected_label=s&prediction_index=1&source_image=data"),
    ("character", "corrected_label=%7E&prediction_index=2&source_image=data"),
    ("character", "corrected_label=A&prediction_index=1&broken"),
]


def form_bodies(spark: SparkSession, root: str) -> DataFrame:
    """(event_id, body): URL-encoded forms, each kind of fault in turn, some with a repeated key."""

    fault = (F.col("event_id") % len(FORM_TAILS)).cast("int")
    kinds = F.array(*[F.lit(kind) for kind, _ in FORM_TAILS])
    tails = F.array(*[F.lit(tail) for _, tail in FORM_TAILS])
    image = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("practice-"), "user_id")).otherwise(F.col("user_id").cast("string"))
    again = F.when(F.col("event_id") % 5 == 0, "&filename=second+file.png").otherwise("")
    return spread(spark, root, "events").select(
        "event_id",
        F.concat(
            F.lit("filename=first.png&correction_kind="), F.get(kinds, fault), F.lit("&image_id="), image,
            F.lit(f"&confidence=0.5&original_label=ab&bbox={_BBOX}&"), F.get(tails, fault), again,
        ).alias("body"),
    )


# ---------------------------------------------------------------- paths, metrics


def path_table(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """(path, rel, p_partkey): a file listing in one of the folder layouts."""

    code = 33 + F.col("p_partkey") % 94
    number = F.format_string("Sample%03d", F.col("p_partkey") % 70)
    rel = {
        "hex": F.concat(F.lit("by_class/"), F.lower(F.hex(code)), F.lit("/a/"), "p_partkey", F.lit(".png")),
        "code": F.concat(code.cast("string"), F.lit("/"), "p_partkey", F.when(F.col("p_partkey") % 7 == 0, ".txt").otherwise(".png")),
        "sample": F.concat(number, F.lit("/"), "p_partkey", F.lit(".png")),
        "label": F.concat(F.chr(F.when(F.col("p_partkey") % 2 == 0, 65).otherwise(97) + F.col("p_partkey") % 26),
                          F.lit("/"), "p_partkey", F.when(F.col("p_partkey") % 7 == 0, ".txt").otherwise(".PNG")),
    }[layout]
    return table(spark, root, "part").select(rel.alias("path"), rel.alias("rel"), "p_partkey")


def written_folder(spark: SparkSession, root: str, layout: str) -> str:
    """A new folder in the shared scratch place that holds a small file for each part, in one of the folder layouts."""

    folder = scratch_path(spark)
    files = path_table(spark, root, layout).select("rel", F.concat_ws("|", "rel", "p_partkey").cast("binary").alias("content"))
    write_files(files.repartition(spark.sparkContext.defaultParallelism, "rel"), folder)
    return folder


def metric_history(spark: SparkSession, root: str) -> DataFrame:
    """(model, epoch, test_accuracy, train_accuracy): one model per priority, one epoch per month."""

    monthly = (
        table(spark, root, "orders")
        .groupBy(F.col("o_orderpriority").alias("model"), F.date_trunc("month", "o_orderdate").alias("month"))
        .agg(
            (F.count_if(F.col("o_orderstatus") == "F") * 100.0 / F.count("*")).alias("test_accuracy"),
            (F.count_if(F.col("o_orderstatus") != "P") * 100.0 / F.count("*")).alias("train_accuracy"),
        )
    )
    # One row per month and model.
    epoch = F.row_number().over(W.partitionBy("model").orderBy("month"))
    return monthly.select("model", epoch.alias("epoch"), "test_accuracy", "train_accuracy")


# ---------------------------------------------------------------- ink


def word_ink(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, y, x), and the line and w of its word: each word a connected mark of 1 to 3 pixels height, lines 10 apart.

    Words stand as far apart as the longest of their page needs, 32 at least.
    """

    pitch = F.greatest(F.lit(32), F.array_max(F.transform(F.split("text", "[ \n]"), lambda w: F.length(w))) + 5)
    lines = spread(spark, root, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("page_id"), pitch.alias("pitch"), F.split("text", "\n").alias("_lines")
    ).select("page_id", "pitch", F.posexplode("_lines").alias("line", "text"))
    tokens = lines.select("page_id", "pitch", "line", F.posexplode(F.split("text", " ")).alias("w", "word")).filter("word <> ''")
    chars = tokens.select("page_id", "pitch", "line", "w", F.posexplode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("i", "ch"))
    return chars.withColumn("dy", F.explode(F.sequence(F.lit(0), F.ascii("ch") % 3))).select(
        "page_id", (F.col("line") * 10 + F.col("dy")).alias("y"), (F.col("w") * F.col("pitch") + F.col("i")).alias("x"), "line", "w"
    )


def word_boxes(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, box_id, line, x0, y0, x1, y1, width, height): the box of each word on its page, which ends two pixels after its last ink."""

    boxes = word_ink(spark, root).groupBy("page_id", "line", "w").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")
    )
    page = W.partitionBy("page_id")
    per_line = F.greatest(F.lit(10000), F.max("w").over(page) + 1).cast("long")
    return boxes.select(
        "page_id", (F.col("line") * per_line + F.col("w")).alias("box_id"), "line", "x0", "y0", "x1", "y1",
        (F.max("x1").over(page) + 2).alias("width"), (F.max("y1").over(page) + 2).alias("height"),
    )


def banner_ink(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, y, x): supplier names as tall touching glyphs, zeros as thin bridges."""

    chars = spread(spark, root, "supplier").select(
        F.col("s_suppkey").alias("page_id"), F.posexplode(F.split("s_name", "")).alias("i", "ch")
    ).filter("ch <> ''")
    columns = chars.select("page_id", "i", "ch", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("dx"))
    tall = 24 + (F.ascii("ch") * 7 + F.col("dx") * 5) % 12
    top = F.when((F.col("ch") == "0") & (F.col("i") % 4 == 1), 1).otherwise(tall)
    return columns.withColumn("dy", F.explode(F.sequence(F.lit(0), top - 1))).select(
        "page_id", (F.col("dy") + 4).alias("y"), (F.col("i") * 12 + F.col("dx")).alias("x")
    )


def scattered_boxes(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, box_id, x0, y0, x1, y1): twenty boxes a page, some tiny, many close to each other."""

    key = F.col("p_partkey")
    i = key % 20
    tiny = key % 4 == 0
    w = F.when(tiny, 4 + key % 9).otherwise(6 + key * 5 % 26)
    h = F.when(tiny, 4 + key % 7).otherwise(8 + key * 11 % 50)
    x0 = i % 10 * 30 + key % 7
    y0 = F.floor(i / 10) * 70 + key * 3 % 25 + 10
    return as_ints(
        spread(spark, root, "part", page_id=F.floor(key / 20)).select(
            "page_id", key.alias("box_id"), x0.alias("x0"), y0.alias("y0"),
            (x0 + w).alias("x1"), (y0 + h).alias("y1"),
        ),
        ["x0", "y0", "x1", "y1"],
    )


def as_ints(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def scattered_ink(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, y, x): every second pixel row of each scattered box."""

    rows = scattered_boxes(spark, root).withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1, F.lit(2))))
    return rows.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))).select("page_id", "y", "x").distinct()


def grid_pixels(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, y, x, v, width, height): each vector as an 8 by 8 picture, every third one bright."""

    v = F.least(F.lit(1.0), F.abs(F.col("e")) * 3)
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("page_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e")
    ).select(
        "page_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"),
        F.when(F.col("page_id") % 3 == 0, 1.0 - v).otherwise(v).alias("v"), F.lit(8).alias("width"), F.lit(8).alias("height"),
    )


def stroke_regions(spark: SparkSession, root: str) -> DataFrame:
    """(region_id, width, height, y, x): one simple stroke shape per part, 40 pixels high."""

    # Repeated parts go first; the pixels of those left differ, but for the two strokes of one pixel row.
    parts = spread(spark, root, "part").select(
        F.col("p_partkey").alias("region_id"), (10 + F.col("p_size") % 24).alias("width")
    ).distinct()
    rows = parts.select(
        "region_id", "width", F.lit(40).alias("height"), (F.col("region_id") % 6).alias("shape"),
        F.explode(F.sequence(F.lit(0), F.lit(39))).alias("y"),
    )
    w, y, shape = F.col("width"), F.col("y"), F.col("shape")
    bulge = F.floor((y - 20) * (y - 20) * (w - 2) / 1240).cast("int")
    a = (
        F.when(shape == 0, F.floor(w / 2))
        .when(shape == 1, F.when(y < 6, 0).otherwise(w - 2))
        .when(shape == 2, bulge)
        .when(shape == 3, w - 2 - bulge)
        .when(shape == 4, F.when((y >= 18) & (y < 22), 0).when(y < 18, F.floor(w * (18 - y) / 36)).otherwise(w - 2))
        .otherwise(F.floor(w / 2))
    ).cast("int")
    b = (
        F.when((shape == 1) & (y < 6), w - 1)
        .when((shape == 4) & (y >= 18) & (y < 22), w - 1)
        .otherwise(a + 1)
    ).cast("int")
    blank = (shape == 5) & (y >= 5) & (y < 9)
    stroke, post = F.sequence(a, b), F.sequence(w - 2, w - 1)
    inked = F.when((shape == 4) & (y < 18), F.array_union(stroke, post)).otherwise(stroke)
    return rows.filter(~blank).select("region_id", "width", "height", "y", F.explode(inked).alias("x"))


# ---------------------------------------------------------------- DuckDB side

SQL: dict[str, str] = {}
_NEEDS: dict[str, list[str]] = {}


def _sql(name: str, text: str, *needs: str) -> None:
    SQL[name] = text
    _NEEDS[name] = list(needs)


def with_ctes(names: list[str], body: str) -> str:
    """A statement with the named expressions and what they need in front."""

    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered) + "\n" + body


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_sql(
    "glyphs",
    f"""SELECT vec_id AS sample_id, label AS target, {_list(TWIN_LABELS)}[label + 1] AS label,
    'src' || (vec_id % 3) AS source, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings""",
)
_sql(
    "split",
    """SELECT *, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY md5('42|' || sample_id), sample_id)
    <= (15 * count(*) OVER (PARTITION BY target) + 50) // 100 THEN 'validation' ELSE 'train' END AS split FROM glyphs""",
    "glyphs",
)
_sql(
    "bank",
    """SELECT * FROM split WHERE split = 'train'
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY sample_id) <= 80""",
    "split",
)
_sql(
    "scored",
    """SELECT q.sample_id, q.sample_id // 64 AS batch_id, q.label AS expected, b.sample_id AS exemplar_id,
    b.label AS predicted, list_distance(q.vec, b.vec) AS distance
    FROM split q, bank b WHERE q.split = 'validation'
    QUALIFY row_number() OVER (PARTITION BY q.sample_id ORDER BY list_distance(q.vec, b.vec), b.sample_id) = 1""",
    "bank",
)
_sql(
    "words",
    """SELECT conv_id, turn, conv_id || '-' || turn AS page_id, r AS row, word, places FROM (
    SELECT conv_id, turn, greatest(100, list_max(list_transform(ws, lambda z: length(z))) + 1) AS places, unnest(ws) AS word, generate_subscripts(ws, 1) AS r
    FROM (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM conversations)) WHERE word <> ''""",
)


def _predictions_sql(reading: str) -> str:
    source, glyphs = (text.replace("'", "''") for text in READINGS[reading])
    label = f"translate(ch, '{source}', '{glyphs}')"
    return f"""SELECT page_id, conv_id, turn, row, pos, CAST(row * places + pos AS INTEGER) AS idx, label, label AS shown,
    ((conv_id * 31 + turn * 7 + row * 17 + pos * 13) % 1000) / 1000.0::DOUBLE AS confidence,
    pos * 12.0::DOUBLE AS x,
    CASE WHEN stem THEN 100.0 WHEN label IN ('i', '''') THEN 70.0 WHEN label = '.' THEN 158.0
      WHEN label = ':' THEN 120.0 ELSE 160.0 - height END::DOUBLE AS y,
    width::DOUBLE AS width, height::DOUBLE AS height,
    translate(label, '{CASE_AND_TWIN_FROM}', '{CASE_AND_TWIN_TO}') AS alt2,
    ((row * 29 + pos * 41 + turn) % 600) / 1000.0::DOUBLE AS conf2,
    chr(CAST(33 + (ascii(ch) + row) % 94 AS INTEGER)) AS alt3, ((row * 3 + pos * 5) % 400) / 1000.0::DOUBLE AS conf3
    FROM (SELECT *, CASE WHEN stem THEN 56.0 WHEN dot THEN 10.0 WHEN regexp_matches(label, '^[A-Z0-9]$') THEN 60.0 ELSE 36.0 END AS height,
      CASE WHEN stem THEN 8.0 + ascii(ch) % 12 WHEN dot THEN 10.0 ELSE 8.0 + ascii(ch) % 24 END AS width FROM (
      SELECT *, label IN ('l', 'I', '1', '|', '!') AS stem, label IN ('i', '.', '''', ':') AS dot FROM (
        SELECT *, {label} AS label FROM (
          SELECT conv_id, turn, page_id, row, places, unnest(regexp_extract_all(word, '(?s).')) AS ch,
          generate_subscripts(regexp_extract_all(word, '(?s).'), 1) AS pos FROM words))))"""


_sql("preds", _predictions_sql("plain"), "words")
_sql("twins", _predictions_sql("twins"), "words")
_sql("marked", _predictions_sql("marks"), "words")
_sql(
    "text_rows",
    f"""SELECT doc_id AS page_id, unnest(rows) AS text, generate_subscripts(rows, 1) AS row FROM (
    SELECT doc_id, list_concat([({_list(PATTERN_ROWS)})[doc_id % {len(PATTERN_ROWS)} + 1],
    ({_list(PATTERN_ROWS)})[(doc_id + doc_id // {len(PATTERN_ROWS)}) % {len(PATTERN_ROWS)} + 1]],
    string_split(text, chr(10))) AS rows FROM documents)""",
)
_sql(
    "fb",
    """SELECT *, kind_sel IN (0, 2) AS two,
    CASE WHEN kind_sel = 0 THEN CASE WHEN event_id % 12 = 0 THEN 1 ELSE 2 END ELSE 0 END AS n_boxes,
    CASE WHEN event_id % 40 = 7 THEN '' ELSE uid END AS image_id,
    CASE WHEN kind_sel IN (0, 2) THEN c1 || c2 ELSE c1 END AS corrected_label FROM (
    SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS uid, k, event_id % 6 AS kind_sel,
    chr(CAST(33 + k % 94 AS INTEGER)) AS c1, chr(CAST(33 + (k * 7 + event_id) % 94 AS INTEGER)) AS c2 FROM (
    SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))""",
)
# Character rows are always usable, sequences need two boxes: their own, or those of a page with two regions.
_sql(
    "items",
    """SELECT event_id, uid, k, c1 AS label, c1 AS ch1, '' AS ch2, 1 AS item_index, 'own' AS boxes FROM fb
      WHERE event_id % 50 <> 0 AND image_id <> '' AND user_id % 4 <> 0 AND NOT two
    UNION ALL SELECT event_id, uid, k, CASE WHEN i = 1 THEN c1 ELSE c2 END, c1, c2, i,
      CASE WHEN kind_sel = 0 THEN 'own' ELSE 'page' END FROM fb, (VALUES (1), (2)) v(i)
      WHERE event_id % 50 <> 0 AND image_id <> '' AND user_id % 4 <> 0
      AND (n_boxes = 2 OR (kind_sel = 2 AND user_id % 3 = 0))""",
    "fb",
)
_sql(
    "history",
    """SELECT o_orderpriority AS model, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) AS INTEGER) AS epoch,
    f * 100.0::DOUBLE / n AS test_accuracy, fo * 100.0::DOUBLE / n AS train_accuracy FROM (
    SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, count(*) AS n,
    count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus <> 'P') AS fo
    FROM orders GROUP BY 1, 2)""",
)
_sql(
    "word_chars",
    """SELECT page_id, pitch, line, w, unnest(regexp_extract_all(word, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(word, '(?s).'), 1) - 1 AS i FROM (
    SELECT page_id, pitch, line, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS w FROM (
    SELECT page_id, pitch, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM (
    SELECT conv_id || '-' || turn AS page_id, text,
    greatest(32, list_max(list_transform(string_split(replace(text, chr(10), ' '), ' '), lambda z: length(z))) + 5) AS pitch FROM conversations))) WHERE word <> ''""",
)
_sql(
    "word_ink",
    """SELECT page_id, line, w, CAST(line * 10 + dy AS INTEGER) AS y, CAST(w * pitch + i AS INTEGER) AS x
    FROM word_chars, (VALUES (0), (1), (2)) v(dy) WHERE dy <= ascii(ch) % 3""",
    "word_chars",
)
_sql(
    "word_boxes",
    """SELECT page_id, line * greatest(10000, max(w) OVER (PARTITION BY page_id) + 1) + w AS box_id, line, x0, y0, x1, y1, pixels,
    max(x1) OVER (PARTITION BY page_id) + 2 AS width, max(y1) OVER (PARTITION BY page_id) + 2 AS height FROM (
    SELECT page_id, line, w, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS pixels FROM word_ink GROUP BY page_id, line, w)""",
    "word_ink",
)
_sql(
    "pixels",
    """SELECT vec_id AS page_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
    CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE - v ELSE v END AS v FROM (
    SELECT vec_id, i, least(1.0::DOUBLE, abs(e) * 3) AS v FROM (
    SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))""",
)
_sql(
    "strokes",
    """SELECT DISTINCT region_id, width, 40 AS height, y, unnest(generate_series(a, b)) AS x FROM (
    SELECT *, CASE WHEN (shape = 1 AND y < 6) OR (shape = 4 AND y >= 18 AND y < 22) THEN width - 1 ELSE a + 1 END AS b FROM (
    SELECT *, CASE shape WHEN 0 THEN width // 2 WHEN 1 THEN CASE WHEN y < 6 THEN 0 ELSE width - 2 END
      WHEN 2 THEN ((y - 20) * (y - 20) * (width - 2)) // 1240 WHEN 3 THEN width - 2 - ((y - 20) * (y - 20) * (width - 2)) // 1240
      WHEN 4 THEN CASE WHEN y >= 18 AND y < 22 THEN 0 WHEN y < 18 THEN (width * (18 - y)) // 36 ELSE width - 2 END
      ELSE width // 2 END AS a FROM (
    SELECT p_partkey AS region_id, 10 + p_size % 24 AS width, p_partkey % 6 AS shape, y FROM part, range(0, 40) r(y)))
    WHERE NOT (shape = 5 AND y >= 5 AND y < 9)
    UNION ALL SELECT p_partkey, 10 + p_size % 24, p_partkey % 6, y, 8 + p_size % 24, 9 + p_size % 24
      FROM part, range(0, 18) r(y) WHERE p_partkey % 6 = 4)""",
)
_sql(
    "banner_columns",
    """SELECT page_id, CAST(i * 12 + dx AS INTEGER) AS x, CASE WHEN ch = '0' AND i % 4 = 1 THEN 1 ELSE 24 + (ascii(ch) * 7 + dx * 5) % 12 END AS n FROM (
    SELECT s_suppkey AS page_id, unnest(string_split(s_name, '')) AS ch, generate_subscripts(string_split(s_name, ''), 1) - 1 AS i FROM supplier), range(0, 12) r(dx)""",
)
_sql(
    "scattered",
    """SELECT k // 20 AS page_id, k AS box_id, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x0 + w AS INTEGER) AS x1, CAST(y0 + h AS INTEGER) AS y1 FROM (
    SELECT p_partkey AS k, p_partkey % 20 % 10 * 30 + p_partkey % 7 AS x0, p_partkey % 20 // 10 * 70 + p_partkey * 3 % 25 + 10 AS y0,
    CASE WHEN p_partkey % 4 = 0 THEN 4 + p_partkey % 9 ELSE 6 + p_partkey * 5 % 26 END AS w,
    CASE WHEN p_partkey % 4 = 0 THEN 4 + p_partkey % 7 ELSE 8 + p_partkey * 11 % 50 END AS h FROM part)""",
)


# ---------------------------------------------------------------- recursive statements


def _row_ctes(boxes: str, prefix: str) -> None:
    """``{prefix}_rows``: the boxes with row and place, centres walked one by one as a list of rows with running sums."""

    _sql(
        f"{prefix}_centers",
        f"""SELECT page_id, list({{'cy': cy, 'n': n, 'top': top}} ORDER BY cy) AS cs, any_value(tol) AS tol FROM (
        SELECT page_id, (y0 + y1) / 2.0::DOUBLE AS cy, count(*) AS n, min(y0) AS top FROM {boxes} GROUP BY 1, 2) JOIN (
        SELECT page_id, greatest(8.0::DOUBLE, median(y1 - y0) * 0.7::DOUBLE) AS tol FROM {boxes} GROUP BY 1) USING (page_id) GROUP BY 1""",
        boxes,
    )
    new = "{'total': cy * n, 'n': n, 'top': top, 'members': [cy]}"
    grown = "{'total': r.total + cy * n, 'n': r.n + n, 'top': least(r.top, top), 'members': list_append(r.members, cy)}"
    _sql(
        f"{prefix}_folded",
        f"""SELECT page_id, 0 AS k, []::STRUCT(total DOUBLE, n BIGINT, top INTEGER, members DOUBLE[])[] AS rs FROM {prefix}_centers
        UNION ALL SELECT page_id, k + 1, CASE WHEN hit > 0 THEN list_transform(rs, lambda r, i: CASE WHEN i = hit THEN {grown} ELSE r END)
          ELSE list_append(rs, {new}) END FROM (
          SELECT *, coalesce(list_position(list_transform(rs, lambda r: abs(cy - r.total / r.n) <= tol), true), 0) AS hit FROM (
            SELECT f.page_id, k, rs, tol, cs[k + 1].cy AS cy, cs[k + 1].n AS n, cs[k + 1].top AS top
            FROM {prefix}_folded f JOIN {prefix}_centers c ON c.page_id = f.page_id WHERE k < len(cs)))""",
        f"{prefix}_centers",
    )
    _sql(
        f"{prefix}_rows",
        f"""SELECT b.*, CAST(rw AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY b.page_id, rw ORDER BY b.x0, (b.y0 + b.y1) / 2.0::DOUBLE, b.y0, b.x1, b.y1) AS INTEGER) AS place
        FROM {boxes} b JOIN (
          SELECT page_id, rw, unnest(r.members) AS cy FROM (
            SELECT page_id, r, row_number() OVER (PARTITION BY page_id ORDER BY r.top, i) AS rw FROM (
              SELECT f.page_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM {prefix}_folded f JOIN {prefix}_centers c ON c.page_id = f.page_id WHERE k = len(cs)))) m
        ON m.page_id = b.page_id AND m.cy = (b.y0 + b.y1) / 2.0::DOUBLE""",
        f"{prefix}_folded",
    )


_row_ctes("scattered", "scattered")
_sql(
    "scattered_px",
    """SELECT DISTINCT page_id, y, x FROM (SELECT page_id, x0, x1, unnest(range(y0, y1, 2)) AS y FROM scattered) b, range(0, 400) r(x)
    WHERE x >= x0 AND x < x1""",
    "scattered",
)
_sql(
    "scattered_sized",
    """SELECT r.*, coalesce(n, 0) AS area FROM scattered_rows r LEFT JOIN (
    SELECT s.page_id, s.box_id, count(*) AS n FROM scattered s JOIN scattered_px p ON p.page_id = s.page_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2)
    USING (page_id, box_id)""",
    "scattered_rows", "scattered_px",
)


def recursive(statement: str) -> str:
    return statement.replace("WITH ", "WITH RECURSIVE ", 1)
