"""Queries on predictions: guesses, repair, merging, routing, arbitration, page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions import labels as L
from glyphloom.functions import predictions as P
from glyphloom.functions import text as X
from glyphloom.operators import arbitration, marks, routing, rows, twins
from glyphloom.plans import standins as T
from glyphloom.plans.labels_catalog import _group_sql
from glyphloom.plans.registry import guesses_text, query, rounded
from glyphloom.plans.standins import with_ctes

KEY = ["page_id", "idx"]


@query(
    "p06_shown_label",
    """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN chr(CAST(65 + p_partkey % 26 AS INTEGER)) END,
    CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey % 10 AS VARCHAR) END, '') AS shown FROM part""",
)
def shown_label(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("p_partkey")
    return T.table(spark, root, "part").select(
        "p_partkey",
        P.shown_label(F.when(key % 3 == 0, F.chr(65 + key % 26)), F.when(key % 3 == 1, (key % 10).cast("int"))).alias("shown"),
    )


# The three guesses of a prediction as rows, best first.
_RANKED = """, g AS (SELECT page_id, idx, shown, confidence, i, CASE i WHEN 1 THEN label WHEN 2 THEN alt2 ELSE alt3 END AS gl,
    CASE i WHEN 1 THEN confidence WHEN 2 THEN conf2 ELSE conf3 END AS gc FROM preds, (VALUES (1), (2), (3)) v(i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, idx ORDER BY gc DESC, i) AS k FROM g WHERE gl <> '')"""


def _ranked(body: str) -> str:
    return with_ctes(["preds"], _RANKED + "\n" + body).replace("\n, g AS", ",\ng AS")


@query(
    "p07_top_guesses",
    _ranked("SELECT page_id, idx, string_agg(gl || ':' || printf('%.3f', gc), ' ' ORDER BY k) AS guesses FROM r GROUP BY 1, 2"),
)
def top_guesses(spark: SparkSession, root: str) -> DataFrame:
    return T.predictions(spark, root).select(
        *KEY, guesses_text(P.top_guesses(F.col("alternatives"))).alias("guesses")
    )


@query(
    "p07_compact_guesses",
    with_ctes(
        ["preds"],
        """, d AS (SELECT page_id, idx, chr(CAST(65 + row % 26 AS INTEGER)) AS sel, label || ':' || printf('%.3f', confidence)
            || CASE WHEN alt2 <> label THEN ' ' || alt2 || ':' || printf('%.3f', conf2) ELSE '' END
            || CASE WHEN alt3 <> label AND alt3 <> alt2 THEN ' ' || alt3 || ':' || printf('%.3f', conf3) ELSE '' END AS txt,
            label, alt2, alt3 FROM preds)
        SELECT page_id, idx, CASE WHEN sel IN (label, alt2, alt3) THEN txt
          ELSE array_to_string(list_slice(list_concat([sel || ':0.000'], string_split(txt, ' ')), 1, 3), ' ') END AS guesses FROM d""",
    ).replace("\n, d AS", ",\nd AS"),
)
def compact_guesses(spark: SparkSession, root: str) -> DataFrame:
    selected = F.chr(65 + F.col("row") % 26)
    return T.predictions(spark, root).select(
        *KEY, guesses_text(P.compact_guesses(F.col("alternatives"), selected)).alias("guesses")
    )


@query(
    "p08_uncertain_flag",
    _ranked(
        """SELECT page_id, idx, CASE WHEN any_value(confidence) < 0.80 THEN true
          WHEN max(CASE WHEN k = 1 THEN gl END) <> any_value(shown) AND max(CASE WHEN k = 1 THEN gc END) >= any_value(confidence) THEN true
          ELSE max(CASE WHEN k = 1 THEN gc END) - max(CASE WHEN k = 2 THEN gc END) <= 0.12::DOUBLE END AS uncertain,
        CASE WHEN any_value(confidence) < 0.75 THEN true
          ELSE max(CASE WHEN i = 1 THEN gc END) - max(CASE WHEN i = 2 THEN gc END) < 0.15::DOUBLE END AS uncertain_compact
        FROM r GROUP BY page_id, idx"""
    ),
)
def uncertain_flag(spark: SparkSession, root: str) -> DataFrame:
    top = T.predictions(spark, root).withColumn("top", P.top_guesses(F.col("alternatives")))
    return top.select(
        *KEY, P.is_uncertain(F.col("shown"), F.col("confidence"), F.col("top")).alias("uncertain"),
        P.is_uncertain_compact(F.col("confidence"), F.col("alternatives")).alias("uncertain_compact"),
    )


@query(
    "p09_ambiguity_note",
    _ranked(
        f"""SELECT page_id, idx, coalesce(min_by('ambiguous with ' || gl || ' ' || printf('%.1f', gc * 100) || '%', k) FILTER (
          gl <> shown AND NOT (gc < 0.18 AND confidence - gc > 0.20::DOUBLE) AND {_group_sql('shown', 'gl', L.DISPLAY_GROUPS)}), '') AS note
        FROM r GROUP BY page_id, idx"""
    ),
)
def ambiguity_note(spark: SparkSession, root: str) -> DataFrame:
    top = T.predictions(spark, root).withColumn("top", P.top_guesses(F.col("alternatives")))
    return top.select(*KEY, P.ambiguity_note(F.col("shown"), F.col("confidence"), F.col("top")).alias("note"))


@query(
    "p10_alternative_confidence",
    with_ctes(
        ["preds"],
        """SELECT page_id, idx, greatest(CASE WHEN label IN ('o', 'O', '0') THEN confidence ELSE 0.0 END,
        CASE WHEN alt2 IN ('o', 'O', '0') THEN conf2 ELSE 0.0 END, CASE WHEN alt3 IN ('o', 'O', '0') THEN conf3 ELSE 0.0 END)::DOUBLE AS strongest,
        greatest(confidence, 0.84)::DOUBLE AS floored FROM preds""",
    ),
)
def alternative_confidence(spark: SparkSession, root: str) -> DataFrame:
    return T.predictions(spark, root).select(
        *KEY, P.alternative_confidence(F.col("alternatives"), ["o", "O", "0"]).alias("strongest"),
        F.greatest("confidence", F.lit(0.84)).alias("floored"),
    )


@query(
    "p11_case_pair_alternatives",
    with_ctes(
        ["preds"],
        """SELECT page_id, idx, CASE WHEN regexp_matches(label, '^[A-Za-z]$') AND label <> alt2 AND lower(label) = lower(alt2) AND least(confidence, conf2) >= 0.20
        THEN CASE WHEN confidence >= conf2 THEN label || ':' || printf('%.3f', confidence) || ' ' || alt2 || ':' || printf('%.3f', conf2)
          ELSE alt2 || ':' || printf('%.3f', conf2) || ' ' || label || ':' || printf('%.3f', confidence) END
        WHEN regexp_matches(label, '^[A-Za-z]$') AND label <> alt3 AND lower(label) = lower(alt3) AND least(confidence, conf3) >= 0.20
        THEN CASE WHEN confidence >= conf3 THEN label || ':' || printf('%.3f', confidence) || ' ' || alt3 || ':' || printf('%.3f', conf3)
          ELSE alt3 || ':' || printf('%.3f', conf3) || ' ' || label || ':' || printf('%.3f', confidence) END
        WHEN regexp_matches(alt2, '^[A-Za-z]$') AND alt2 <> alt3 AND lower(alt2) = lower(alt3) AND least(conf2, conf3) >= 0.20
        THEN CASE WHEN conf2 >= conf3 THEN alt2 || ':' || printf('%.3f', conf2) || ' ' || alt3 || ':' || printf('%.3f', conf3)
          ELSE alt3 || ':' || printf('%.3f', conf3) || ' ' || alt2 || ':' || printf('%.3f', conf2) END
        ELSE '' END AS pair FROM preds""",
    ),
)
def case_pair_alternatives(spark: SparkSession, root: str) -> DataFrame:
    return T.predictions(spark, root).select(*KEY, guesses_text(P.case_pair(F.col("alternatives"))).alias("pair"))


# ------------------------------------------------------------------ text

_GREET = "regexp_matches(t, '^[Hh][LI1|][^\\p{L}\\p{N}]*$')"


def _clean_sql(source: str) -> str:
    """The eight rules as nested selects over ``text``."""

    words = ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{b}')" for a, b in X.KNOWN_WORDS.items())
    n = lambda m: "'" + m.replace("'", "''") + "'"
    opened = "length(t) - length(replace(t, '(', ''))"
    closed = "length(t) - length(replace(t, ')', ''))"
    stages = [
        (f"CASE WHEN {_GREET} THEN substr(t, 1, 1) || 'i' || substr(t, 3) ELSE t END", f"CASE WHEN {_GREET} THEN {n(X.NOTE_GREETING)} END"),
        (
            "CASE WHEN t IN ('Hi''', 'Hi`', 'hi''', 'hi`', 'Hiy', 'hiy') THEN substr(t, 1, 2) || '.' ELSE t END",
            f"CASE WHEN t IN ('Hi''', 'Hi`', 'hi''', 'hi`') THEN {n(X.NOTE_APOSTROPHE)} WHEN t IN ('Hiy', 'hiy') THEN {n(X.NOTE_TINY_Y)} END",
        ),
        (
            "CASE WHEN regexp_matches(t, '^[cC][aA][nN][''`Dd%][tT7]$') THEN 'can''t' ELSE t END",
            f"CASE WHEN regexp_matches(t, '^[cC][aA][nN][''`Dd%][tT7]$') THEN {n(X.NOTE_CONTRACTION)} END",
        ),
        (
            f"coalesce((SELECT b FROM (VALUES {words}) w(a, b) WHERE a = t), t)",
            f"CASE WHEN t IN (SELECT a FROM (VALUES {words}) w(a, b)) THEN {n(X.NOTE_WORD)} END",
        ),
        (
            "CASE WHEN regexp_matches(t, '^[T7][eE:][sS5][tT7]$') THEN 'Test' ELSE t END",
            f"CASE WHEN regexp_matches(t, '^[T7][eE:][sS5][tT7]$') THEN {n(X.NOTE_TEST)} END",
        ),
        (
            "CASE WHEN t IN ('p5', 'P5') THEN '15' WHEN t = '2T' THEN '27' ELSE t END",
            f"CASE WHEN t IN ('p5', 'P5') THEN {n(X.NOTE_P5)} WHEN t = '2T' THEN {n(X.NOTE_2T)} END",
        ),
        (
            r"CASE WHEN regexp_matches(t, '^[1IlL\[][0-9]{2,}[1IlL\]]$') THEN '(' || substr(t, 2, length(t) - 2) || ')' ELSE t END",
            r"CASE WHEN regexp_matches(t, '^[1IlL\[][0-9]{2,}[1IlL\]]$') THEN " + n(X.NOTE_GROUP) + " END",
        ),
        (
            rf"CASE WHEN {opened} > {closed} AND regexp_matches(t, '[\]}}7LlI1]$') THEN substr(t, 1, length(t) - 1) || ')' ELSE t END",
            rf"CASE WHEN {opened} > {closed} AND regexp_matches(t, '[\]}}7LlI1]$') THEN {n(X.NOTE_OPEN)} END",
        ),
        (
            rf"CASE WHEN {closed} > {opened} AND regexp_matches(t, '^[\[{{LlI1]') THEN '(' || substr(t, 2) ELSE t END",
            rf"CASE WHEN {closed} > {opened} AND regexp_matches(t, '^[\[{{LlI1]') THEN {n(X.NOTE_CLOSE)} END",
        ),
    ]
    sql = f"SELECT *, text AS t, [] :: VARCHAR[] AS notes FROM {source}"
    for value, note in stages:
        sql = f"SELECT * EXCLUDE (t, notes), {value} AS t, CASE WHEN {note} IS NULL THEN notes ELSE list_append(notes, {note}) END AS notes FROM ({sql})"
    return sql


@query(
    "p16_row_cleanup",
    with_ctes(["text_rows"], f"SELECT page_id, row, md5(t) AS cleaned, array_to_string(notes, ' ') AS notes FROM ({_clean_sql('text_rows')})")
    .replace("page_id, row, md5", "page_id, CAST(row AS INTEGER) AS row, md5"),
)
def row_cleanup(spark: SparkSession, root: str) -> DataFrame:
    cleaned = X.clean_rows(T.text_rows(spark, root))
    return cleaned.select("page_id", "row", F.md5("cleaned").alias("cleaned"), F.array_join("notes", " ").alias("notes"))


@query(
    "a22_page_cleanup",
    with_ctes(
        ["text_rows"],
        f""", c AS ({_clean_sql('text_rows')}),
        p AS (SELECT page_id, list(t ORDER BY row) AS ts, flatten(list(notes ORDER BY row)) AS ns FROM c GROUP BY page_id),
        q AS (SELECT *, len(ts) = 2 AND ts[1] = 'Hi' AND ts[2] = ':' AS stray FROM p),
        z AS (SELECT page_id, CASE WHEN stray THEN ['Hi'] ELSE ts END AS ts,
          CASE WHEN stray THEN list_append(ns, 'Dropped an isolated punctuation row after the greeting ''Hi''.') ELSE ns END AS ns FROM q),
        a AS (SELECT page_id, ts, CASE WHEN len(ts) > 1 THEN list_append(ns, 'Kept ' || len(ts) || ' detected rows separated for reading.') ELSE ns END AS ns FROM z)
        SELECT page_id, md5(array_to_string(ts, chr(10))) AS display, CAST(len(ts) AS INTEGER) AS n_rows,
        coalesce((SELECT string_agg(n, ' ' ORDER BY i) FROM (SELECT n, min(i) AS i FROM (
          SELECT unnest(ns) AS n, generate_subscripts(ns, 1) AS i) GROUP BY n)), '') AS notes FROM a""",
    ).replace("\n, c AS", ",\nc AS"),
)
def page_cleanup(spark: SparkSession, root: str) -> DataFrame:
    pages = rows.clean_pages(T.text_rows(spark, root))
    return pages.select(
        "page_id", F.md5("display").alias("display"), F.size("rows").alias("n_rows"), F.array_join("notes", " ").alias("notes")
    )


@query(
    "a21_row_strings",
    with_ctes(["preds"], "SELECT page_id, row, string_agg(shown, '' ORDER BY x, idx) AS text FROM preds GROUP BY page_id, row")
    .replace("page_id, row, string_agg", "page_id, CAST(row AS INTEGER) AS row, string_agg"),
)
def row_strings(spark: SparkSession, root: str) -> DataFrame:
    return rows.row_strings(T.predictions(spark, root))


@query(
    "a21_page_strings",
    with_ctes(["preds"], "SELECT page_id, string_agg(shown, '' ORDER BY idx) AS raw_sequence FROM preds GROUP BY page_id"),
)
def page_strings(spark: SparkSession, root: str) -> DataFrame:
    return rows.page_strings(T.predictions(spark, root))


@query(
    "j12_visible_predictions",
    with_ctes(
        ["preds"],
        """, r AS (SELECT page_id, row, dense_rank() OVER (PARTITION BY page_id ORDER BY row) AS k FROM preds),
        n AS (SELECT page_id, max(k) AS detected, CASE WHEN max(k) % 3 = 0 THEN max(k) // 2 ELSE max(k) END AS kept FROM r GROUP BY 1)
        SELECT page_id, count(*) AS n, CAST(max(row) AS INTEGER) AS last_row FROM preds JOIN n USING (page_id)
        WHERE kept >= detected OR row <= kept GROUP BY page_id""",
    ).replace("\n, r AS", ",\nr AS"),
)
def visible_predictions(spark: SparkSession, root: str) -> DataFrame:
    preds = T.predictions(spark, root)
    detected = preds.groupBy("page_id").agg(F.count_distinct("row").alias("n"))
    kept = F.when(F.col("n") % 3 == 0, F.floor(F.col("n") / 2)).otherwise(F.col("n")).cast("int")
    pages = detected.select("page_id", F.array_repeat(F.lit(""), kept).alias("rows"))
    return rows.visible_predictions(preds, pages).groupBy("page_id").agg(
        F.count("*").alias("n"), F.max("row").alias("last_row")
    )


# ------------------------------------------------------------------ routing


def _word_pages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Every word as a page: character predictions and digit predictions."""

    preds = T.predictions(spark, root, "twins").withColumn(
        "page_id", F.concat_ws("/", "page_id", "row")
    ).withColumn("row", F.lit(1))
    keep = ["page_id", "row", "idx", "shown", "confidence"]
    seed = F.col("conv_id") * 3 + F.col("turn") * 5 + F.col("pos") * 7
    digits = preds.filter(~((F.col("conv_id") % 7 == 3) & (F.col("pos") == 2))).select(
        "page_id", "row", "idx", F.col("pos").cast("string").alias("shown"),
        ((F.lit(900) + seed % 100) / F.lit(1000.0)).alias("confidence"),
    )
    chars = preds.filter(~((F.col("conv_id") % 11 == 5) & (F.col("turn") == 1))).select(*keep)
    return chars, digits


@query(
    "j11_digit_routing",
    with_ctes(
        ["twins"],
        """, p AS (SELECT *, page_id || '/' || row AS pg FROM twins),
        c AS (SELECT pg, count(*) AS n, bool_and(contains('0123456789BIJLOSYZlo', shown)) AS dl,
          count(*) FILTER (regexp_matches(shown, '[A-Za-z]')) AS letters,
          bool_or(contains('BOSo', shown) AND confidence >= 0.82) AS blocked FROM p WHERE NOT (conv_id % 11 = 5 AND turn = 1) GROUP BY pg),
        d AS (SELECT pg, count(*) AS n, min(dc) AS low, avg(dc) AS mean FROM (
          SELECT pg, (900 + (conv_id * 3 + turn * 5 + pos * 7) % 100) / 1000.0::DOUBLE AS dc FROM p WHERE NOT (conv_id % 7 = 3 AND pos = 2)) GROUP BY pg),
        r AS (SELECT pg FROM d LEFT JOIN c USING (pg) WHERE c.n IS NULL OR (c.n = d.n AND dl AND letters <= c.n * 0.25 AND NOT blocked AND low >= 0.88 AND mean >= 0.95))
        SELECT recognizer, count(*) AS n, count(DISTINCT pg) AS pages, round(sum(confidence), 6) AS confidence FROM (
        SELECT pg, 'digits' AS recognizer, (900 + (conv_id * 3 + turn * 5 + pos * 7) % 100) / 1000.0::DOUBLE AS confidence FROM p
          WHERE NOT (conv_id % 7 = 3 AND pos = 2) AND pg IN (SELECT pg FROM r)
        UNION ALL SELECT pg, 'characters', confidence FROM p WHERE NOT (conv_id % 11 = 5 AND turn = 1) AND pg NOT IN (SELECT pg FROM r))
        GROUP BY recognizer""",
    ).replace("\n, p AS", ",\np AS"),
)
def digit_routing(spark: SparkSession, root: str) -> DataFrame:
    chars, digits = _word_pages(spark, root)
    return routing.route_digits(chars, digits).groupBy("recognizer").agg(
        F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), rounded(F.sum("confidence")).alias("confidence")
    )


_VARIANTS = """SELECT l_orderkey AS region_id, l_partkey, l_suppkey, l_linenumber - 1 AS variant, CAST(l_partkey % 10 AS VARCHAR) AS label,
    l_quantity / 50.0::DOUBLE AS confidence FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1"""


@query(
    "j14_best_variant",
    f"""WITH v AS ({_VARIANTS}), f AS (SELECT region_id, arg_min(confidence, variant) AS fc FROM v GROUP BY 1)
    SELECT region_id, label, confidence, variant FROM v JOIN f USING (region_id)
    QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY CASE WHEN fc >= 0.85 THEN 0 ELSE -confidence END, variant) = 1""",
)
def best_variant(spark: SparkSession, root: str) -> DataFrame:
    lines = T.table(spark, root, "lineitem")
    order = F.struct("l_partkey", "l_suppkey", "l_extendedprice")
    unique = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.min_by(F.struct("l_partkey", "l_quantity"), order).alias("v")
    )
    variants = unique.select(
        F.col("l_orderkey").alias("region_id"), (F.col("l_linenumber") - 1).alias("variant"),
        (F.col("v.l_partkey") % 10).cast("string").alias("label"), (F.col("v.l_quantity") / 50.0).alias("confidence"),
    )
    return routing.best_variant(variants)


# ------------------------------------------------------------------ marks and twins


def _glyphs(spark: SparkSession, root: str, reading: str = "plain") -> DataFrame:
    """Predictions with the columns that marks are told by; an Arrow step takes all columns it gets, so no others go through the exchange."""

    return T.predictions(spark, root, reading).select("page_id", "row", "idx", "label", "confidence", "x", "y", "width", "height")


def _flat(preds: DataFrame) -> DataFrame:
    return preds.select("page_id", "row", "idx", "label", rounded("confidence").alias("confidence"), "x", "y", "width", "height")


_STEM = "a.label IN ('1', 'I', 'L', 'l', '|', '!') AND a.height >= 28 AND a.height / greatest(a.width, 1) >= 2.35"
_REACH = "abs(b.x + b.width / 2 - a.x - a.width / 2) <= greatest(22.0, a.width * 1.5)"
_LIMIT = "greatest(58.0, a.height * 0.55)"


def _dot_sql(side: str, labels: list[str]) -> str:
    members = ", ".join("'" + v.replace("'", "''") + "'" for v in labels)
    return f"{side}.label IN ({members}) AND {side}.width <= 36 AND {side}.height <= 36"


_STEM_RULE = f"{_REACH} AND b.y + b.height <= a.y + a.height * 0.18::DOUBLE AND a.y - b.y - b.height <= {_LIMIT}"
_CLAIMS = {
    "!": (_STEM, _dot_sql("b", marks.EXCLAMATION_DOT_LABELS), f"{_REACH} AND b.y - a.y - a.height BETWEEN 0 AND {_LIMIT}", 0.92, False),
    "i": (_STEM, _dot_sql("b", marks.I_DOT_LABELS), _STEM_RULE, 0.9, False),
    ":": (
        _dot_sql("a", marks.COLON_DOT_LABELS), _dot_sql("b", marks.COLON_DOT_LABELS),
        "b.ord > a.ord AND abs(b.x + b.width / 2 - a.x - a.width / 2) <= 14 AND b.y - a.y - a.height BETWEEN 8 AND 80", 0.9, True,
    ),
}
_GLYPHS = "SELECT page_id, CAST(row AS INTEGER) AS row, idx, label, confidence::DOUBLE AS confidence, x, y, width, height, row_number() OVER (PARTITION BY page_id, row ORDER BY idx) AS ord FROM marked"


def _claims_ctes(source: str, result: str, label: str) -> str:
    """``result``: the glyphs of ``source`` after one rule; one claimant at a time by a recursive walk along each row with the dots used so far."""

    claimant, dot, fits, floor, exclusive = _CLAIMS[label]
    free = "list_filter(k.dots, lambda z: NOT list_contains(w.used, z))[1]"
    pick = f"CASE WHEN list_contains(w.used, k.s) THEN NULL ELSE {free} END" if exclusive else free
    return f"""{result}_e AS (SELECT a.page_id, a.row, a.ord AS s, list(b.ord ORDER BY b.ord) AS dots FROM {source} a JOIN {source} b ON a.page_id = b.page_id AND a.row = b.row
          AND a.ord <> b.ord AND {claimant} AND {dot} AND {fits} GROUP BY 1, 2, 3),
        {result}_k AS (SELECT *, row_number() OVER (PARTITION BY page_id, row ORDER BY s) AS k FROM {result}_e),
        {result}_w AS (SELECT DISTINCT page_id, row, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS s, NULL::BIGINT AS d FROM {result}_k
          UNION ALL SELECT page_id, row, k, CASE WHEN d IS NULL THEN used ELSE list_append(used, d) END, s, d FROM (
            SELECT k.page_id, k.row, k.k, w.used, k.s, {pick} AS d FROM {result}_w w JOIN {result}_k k ON k.page_id = w.page_id AND k.row = w.row AND k.k = w.k + 1)),
        {result}_c AS (SELECT page_id, row, s, d FROM {result}_w WHERE d IS NOT NULL),
        {result} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY page_id, row ORDER BY trunc(x), ord) AS ord) FROM (
          SELECT p.page_id, p.row, p.idx, CASE WHEN c.d IS NULL THEN p.label ELSE '{label}' END AS label,
          CASE WHEN c.d IS NULL THEN p.confidence ELSE greatest(p.confidence, q.confidence, {floor}) END::DOUBLE AS confidence,
          CASE WHEN c.d IS NULL THEN p.x ELSE least(p.x, q.x) END AS x, CASE WHEN c.d IS NULL THEN p.y ELSE least(p.y, q.y) END AS y,
          CASE WHEN c.d IS NULL THEN p.width ELSE greatest(p.x + p.width, q.x + q.width) - least(p.x, q.x) END AS width,
          CASE WHEN c.d IS NULL THEN p.height ELSE greatest(p.y + p.height, q.y + q.height) - least(p.y, q.y) END AS height, p.ord
          FROM {source} p LEFT JOIN {result}_c c ON c.page_id = p.page_id AND c.row = p.row AND c.s = p.ord
          LEFT JOIN {source} q ON q.page_id = c.page_id AND q.row = c.row AND q.ord = c.d
          WHERE NOT EXISTS (SELECT 1 FROM {result}_c u WHERE u.page_id = p.page_id AND u.row = p.row AND u.d = p.ord)))"""


def _placed_sql(source: str) -> str:
    return f"""SELECT * REPLACE (CASE WHEN usable AND rel >= 0.72 THEN '.' WHEN usable AND rel <= 0.35 THEN '''' ELSE label END AS label,
        CASE WHEN usable AND (rel >= 0.72 OR rel <= 0.35) THEN greatest(confidence, 0.9) ELSE confidence END::DOUBLE AS confidence) FROM (
        SELECT *, dot AND bottom - top >= 24 AS usable, (y + height / 2 - top) / greatest(bottom - top, 1.0) AS rel FROM (
        SELECT *, min(CASE WHEN NOT dot THEN y END) OVER w AS top, max(CASE WHEN NOT dot THEN y + height END) OVER w AS bottom FROM (
        SELECT *, label IN ('.', '''', '`', ':') AND width <= 36 AND height <= 36 AS dot FROM {source}) WINDOW w AS (PARTITION BY page_id, row)))"""


def _claims_sql(labels: str, placed: bool = False) -> str:
    """The rules one after another; then dots by their height."""

    steps = [f"p AS ({_GLYPHS})", *(_claims_ctes(f"m{k - 1}" if k else "p", f"m{k}", label) for k, label in enumerate(labels))]
    last = f"m{len(labels) - 1}"
    source = f"({_placed_sql(last)})" if placed else last
    body = ",\n" + ",\n".join(steps) + f"\nSELECT page_id, row, idx, label, round(confidence, 6) AS confidence, x, y, width, height FROM {source}"
    return with_ctes(["marked"], body).replace("\n,\n", ",\n").replace("WITH ", "WITH RECURSIVE ", 1)


@query("j04_stem_dot_merge", _claims_sql("i"))
def stem_dot_merge(spark: SparkSession, root: str) -> DataFrame:
    return _flat(marks.merge_dotted_stems(_glyphs(spark, root, "marks")))


@query("j05_exclamation_merge", _claims_sql("!"))
def exclamation_merge(spark: SparkSession, root: str) -> DataFrame:
    return _flat(marks.merge_exclamations(_glyphs(spark, root, "marks")))


@query("j06_colon_merge", _claims_sql(":"))
def colon_merge(spark: SparkSession, root: str) -> DataFrame:
    return _flat(marks.merge_colons(_glyphs(spark, root, "marks")))


@query("j04_j06_all_mark_merges", _claims_sql("!i:", placed=True))
def all_mark_merges(spark: SparkSession, root: str) -> DataFrame:
    return _flat(marks.merge_marks(_glyphs(spark, root, "marks")))


@query("v06_dot_height", with_ctes(["preds"], f"SELECT page_id, idx, label, confidence FROM ({_placed_sql('preds')})"))
def dot_height(spark: SparkSession, root: str) -> DataFrame:
    return marks.place_dots(_glyphs(spark, root)).select(*KEY, "label", "confidence")


_PAIRS = ["Cc", "Ff", "Kk", "Mm", "Nn", "Oo", "Pp", "Ss", "Uu", "Vv", "Ww", "Xx", "Yy", "Zz"]


def _possible(pair: str, side: str) -> str:
    members = f"('{pair[0]}', '{pair[1]}')"
    return (
        f"({side}label IN {members} OR greatest(CASE WHEN {side}label IN {members} THEN {side}confidence ELSE 0 END, "
        f"CASE WHEN {side}alt2 IN {members} THEN {side}conf2 ELSE 0 END, CASE WHEN {side}alt3 IN {members} THEN {side}conf3 ELSE 0 END) >= 0.02)"
    )


# Only rows of two glyphs look at their neighbour, so only those are windowed by place.
_CASE_SQL = f""", rw AS MATERIALIZED (SELECT page_id, row, count(*) AS cnt, max(height) AS tall, min(height) AS low FROM preds GROUP BY 1, 2),
    n AS MATERIALIZED (SELECT p.*, cnt, tall, low FROM preds p JOIN rw USING (page_id, row)),
    two AS (SELECT * FROM (SELECT page_id, row, idx AS i1, label, confidence, alt2, conf2, alt3, conf3, greatest(width, height) AS s1,
      {', '.join(f'lead({c}) OVER v AS {n}' for c, n in (('idx', 'i2'), ('label', 'blabel'), ('confidence', 'bconfidence'), ('alt2', 'balt2'), ('conf2', 'bconf2'), ('alt3', 'balt3'), ('conf3', 'bconf3'), ('greatest(width, height)', 's2')))}
      FROM n WHERE cnt = 2 WINDOW v AS (PARTITION BY page_id, row ORDER BY x, idx)) WHERE i2 IS NOT NULL),
    paired AS (SELECT page_id, i1, i2, list_filter([{', '.join(f"CASE WHEN {_possible(p, '')} AND {_possible(p, 'b')} THEN '{p}' END" for p in _PAIRS)}], lambda z: z IS NOT NULL) AS found
      FROM two WHERE s1 >= s2 AND s1 >= s2 * 1.10),
    hit AS (SELECT i1 AS idx, page_id, substr(found[1], 1, 1) AS new FROM paired WHERE len(found) = 1
      UNION ALL SELECT i2, page_id, substr(found[1], 2, 1) FROM paired WHERE len(found) = 1),
    h AS (SELECT *, CASE WHEN cnt >= 3 AND tall >= low * 1.28 AND other <> label
      AND greatest(CASE WHEN alt2 = other THEN conf2 ELSE 0 END, CASE WHEN alt3 = other THEN conf3 ELSE 0 END) >= 0.12
      AND ((regexp_matches(label, '[A-Z]') AND height / tall <= 0.76) OR (regexp_matches(label, '[a-z]') AND height / tall >= 0.92)) THEN other END AS new
      FROM (SELECT *, translate(label, 'CFKMNOPSUVWXYZcfkmnopsuvwxyz', 'cfkmnopsuvwxyzCFKMNOPSUVWXYZ') AS other FROM n))
    SELECT h.page_id, h.idx, coalesce(hit.new, h.new, label) AS shown,
    CASE WHEN coalesce(hit.new, h.new) IS NOT NULL THEN greatest(confidence, 0.84) ELSE confidence END::DOUBLE AS confidence
    FROM h LEFT JOIN hit ON hit.page_id = h.page_id AND hit.idx = h.idx"""


@query("v07_case_by_geometry", with_ctes(["preds"], _CASE_SQL).replace("\n, rw AS", ",\nrw AS"))
def case_by_geometry(spark: SparkSession, root: str) -> DataFrame:
    return twins.resolve_twins(T.predictions(spark, root)).select(*KEY, "shown", "confidence")


def _al(i: int, labels: str) -> str:
    """Strongest confidence of any of the labels at place ``i`` of a row kept as lists."""

    cases = ", ".join(f"CASE WHEN contains('{labels}', {g}[{i}]) THEN {c}[{i}] ELSE 0 END" for g, c in (("l", "c1"), ("a2", "c2"), ("a3", "c3")))
    return f"greatest({cases})"


def _row_repair_sql() -> str:
    low, high = "least(w[1], w[2], w[3])", "greatest(w[1], w[2], w[3])"
    spread = lambda r: f"{low} > 0 AND {high} >= {low} * {r}::DOUBLE"
    big, small = f"list_position(w[1:3], {high})", f"list_position(w[1:3], {low})"
    short = "list_position(list_transform(range(1, 4), lambda q: [h[q], w[q]]), list_min(list_transform(range(1, 4), lambda q: [h[q], w[q]])))"
    some = lambda m: f"(regexp_matches(t, '[{m}]') OR " + " OR ".join(f"{_al(i, m)} >= 0.10" for i in (1, 2, 3)) + ")"

    def ranked(tiny: str, upper: str, lower: str, digit: str) -> str:
        return " || ".join(f"CASE WHEN {tiny} = {i} THEN '{lower}' WHEN {big} = {i} THEN '{upper}' ELSE '{digit}' END" for i in (1, 2, 3))

    two_s = "(" + " + ".join(f"CAST({_al(i, 'Ss')} >= 0.10 AS INTEGER)" for i in (1, 2, 3)) + ") >= 2"
    side = f"greatest({_al(3, 'lL')}) >= 0.10"
    pairs = ", ".join(
        f"CASE WHEN (contains('{p}', l[1]) OR {_al(1, p)} >= 0.02) AND (contains('{p}', l[2]) OR {_al(2, p)} >= 0.02) THEN '{p}' END" for p in _PAIRS
    )
    size = [f"greatest(w[{i}], h[{i}])" for i in (1, 2)]
    rules = [
        (f"t = 'T35T' AND {_al(3, 'Ss')} >= 0.10 AND {_al(4, '7')} >= 0.50", "'..s7'", 0.88),
        (f"regexp_matches(t, '^[5Ss]{{3}}$') AND t <> '555' AND {some('Ss')} AND {spread(1.18)}", ranked(small, "S", "s", "5"), 0.84),
        (f"t = '555' AND least({_al(1, 'Ss')}, {_al(3, 'Ss')}) >= 0.12 AND {_al(2, 'Ss')} <= 0.05 AND greatest(w[1], w[3]) >= least(w[1], w[3]) * 1.25",
         "CASE WHEN w[1] > w[3] THEN 'S.s' ELSE 's.S' END", 0.86),
        (f"t = '555' AND {two_s} AND {spread(1.25)} AND {small} = 2", "'Ss.'", 0.84),
        (f"t = '555' AND {two_s} AND {spread(1.25)} AND {small} = 3", "'.Ss'", 0.84),
        (f"regexp_matches(t, '^[0Oo]{{3}}$') AND {some('Oo')} AND {spread(1.20)}", ranked(short, "O", "o", "0"), 0.86),
        (f"regexp_matches(t, '^[2Zz]{{3}}$') AND {some('Zz')} AND {spread(1.20)}", ranked(small, "Z", "z", "2"), 0.84),
        (f"t = 'gqg' AND {_al(1, '9')} >= 0.015", "'9..'", 0.84),
        (f"regexp_matches(t, '^[9qgGQ]{{2}}g$') AND (l[1] = '9' OR {_al(1, '9')} >= 0.10) AND (l[2] = 'q' OR {_al(2, 'q')} >= 0.35)", "'9q.'", 0.84),
        (f"t = 'GGb' AND {_al(2, '6')} >= 0.03 AND w[1] > 0 AND w[2] > 0 AND w[1] >= w[2] * 1.20", "'.6.'", 0.84),
        (f"t = '4y' AND {_al(1, 'Y')} >= 0.80", "'Y.'", 0.84),
        (f"t = '44' AND {_al(1, 'Y')} >= 0.65 AND {_al(2, 'y')} >= 0.18 AND {_al(2, 'y')} >= {_al(2, 'Y')} * 0.35", "'Yy'", 0.84),
        (f"t = '88' AND {_al(1, 'B')} >= 0.50 AND {_al(2, 'B')} < 0.10", "'B.'", 0.84),
        (f"t = 'kk' AND {_al(1, 'K')} >= 0.50 AND {_al(2, 'K')} < {_al(1, 'K')} * 0.35", "'K.'", 0.84),
        (f"t = 'MM' AND {_al(2, 'm')} >= 0.30 AND least(h[1], h[2]) > 0 AND h[1] >= h[2] * 1.15", "'.m'", 0.84),
        (f"t = 'TtT' AND {_al(3, '7')} >= 0.50", "'..7'", 0.84),
        (f"t = 'PP' AND {_al(2, 'p')} >= 0.10 AND w[1] >= w[2] * 1.08", "'.p'", 0.84),
        (f"t = '11i' AND {side} AND least(w[1], w[2]) > 0 AND greatest(w[1], w[2]) >= least(w[1], w[2]) * 1.50",
         "CASE WHEN w[1] > w[2] THEN '1Il' ELSE 'I1l' END", 0.84),
        (f"t = '111' AND {spread(1.45)} AND {big} = 1", "'.Il'", 0.84),
        (f"t = '111' AND {spread(1.45)} AND {big} = 2", "'I.l'", 0.84),
        (f"t IN ('1I1', 'I11') AND {side}", "'..l'", 0.84),
        (f"t IN ('Heiio', 'heiio') AND {_al(3, 'lL')} >= 0.10 AND {_al(4, 'lL')} >= 0.10", "'..ll.'", 0.84),
        (f"t = 'HELL0' AND {_al(5, 'Oo')} >= 0.10", "'....O'", 0.84),
        (f"t = 'CAt' AND {_al(2, 'a')} >= 0.10", "'.a.'", 0.84),
        (f"t = 'u5A' AND {_al(1, 'U')} >= 0.50 AND {_al(2, 'S')} >= 0.40", "'US.'", 0.84),
        (f"t = 'Abc123' AND {_al(1, 'a')} >= 0.10", "'a.....'", 0.84),
        (f"t = 'I11!' AND {_al(2, 'lL')} >= 0.50", "'.l1.'", 0.86),
        (f"t = '111!' AND w[3] = {high}", "'Il1.'", 0.86),
        ("regexp_matches(t, '^[1Ili]{3}!$') AND w[1] < w[2] AND w[2] < w[3]", "'Il1.'", 0.86),
        (f"length(t) = 2 AND len(list_filter([{pairs}], lambda z: z IS NOT NULL)) = 1 AND {size[0]} >= {size[1]} AND {size[0]} >= {size[1]} * 1.10",
         f"list_filter([{pairs}], lambda z: z IS NOT NULL)[1]", 0.84),
    ]
    cases = " ".join(f"WHEN {when} THEN struct_pack(labels := {labels}, floor := {floor}::DOUBLE)" for when, labels, floor in rules)
    kept = ", ".join(f"list({c} ORDER BY x, idx) AS {n}" for c, n in (
        ("idx", "ids"), ("width", "w"), ("height", "h"), ("label", "l"), ("confidence", "c1"), ("alt2", "a2"), ("conf2", "c2"), ("alt3", "a3"), ("conf3", "c3")))
    return with_ctes(
        ["twins"],
        f""", g AS (SELECT page_id, row, string_agg(label, '' ORDER BY x, idx) AS t, {kept} FROM twins GROUP BY 1, 2 HAVING count(*) <= 6),
        r AS (SELECT page_id, row, ids, CASE {cases} END AS res FROM g),
        z AS (SELECT page_id, row, unnest(ids) AS idx, generate_subscripts(ids, 1) AS at, res FROM r WHERE res IS NOT NULL),
        n AS (SELECT *, count(*) OVER v AS cnt, max(height) OVER v AS tall, min(height) OVER v AS low,
          translate(label, 'CFKMNOPSUVWXYZcfkmnopsuvwxyz', 'cfkmnopsuvwxyzCFKMNOPSUVWXYZ') AS other FROM twins WINDOW v AS (PARTITION BY page_id, row)),
        f AS (SELECT n.page_id, n.row, n.idx, n.label, n.confidence, coalesce(z.res.floor, 0.84) AS floor,
          CASE WHEN z.res IS NOT NULL THEN nullif(substr(z.res.labels, z.at, 1), '.')
            WHEN cnt >= 3 AND low > 0 AND tall >= low * 1.28 AND other <> label
              AND greatest(CASE WHEN alt2 = other THEN conf2 ELSE 0 END, CASE WHEN alt3 = other THEN conf3 ELSE 0 END) >= 0.12
              AND ((regexp_matches(label, '[A-Z]') AND height / tall <= 0.76) OR (regexp_matches(label, '[a-z]') AND height / tall >= 0.92)) THEN other END AS new
          FROM n LEFT JOIN z ON z.page_id = n.page_id AND z.row = n.row AND z.idx = n.idx)
        SELECT page_id, CAST(row AS INTEGER) AS row, idx, label AS shown, new AS repaired, round(greatest(confidence, floor), 6)::DOUBLE AS confidence FROM f
        WHERE new IS NOT NULL AND (new <> label OR floor > confidence)""",
    ).replace("\n, g AS", ",\ng AS")


@query("j13_known_row_repair", _row_repair_sql())
def known_row_repair(spark: SparkSession, root: str) -> DataFrame:
    before = T.predictions(spark, root, "twins").filter(F.col("page_id").isNotNull() & F.col("idx").isNotNull())
    # What a glyph was goes with it. A glyph of a repeated key meets every one of that key as it was, once each by
    # ``_id``, also where its repair gave it twice; the page that glyphs are dealt by holds them all.
    was = before.withColumns({"_shown": F.col("shown"), "_was": F.col("confidence"), "_id": F.monotonically_increasing_id()})
    after = twins.resolve_twins(was).select(*KEY, "shown", "confidence", F.struct("_id", "row", "_shown", "_was").alias("_own"))
    same = W.partitionBy(*KEY)
    met = after.withColumn("_met", F.collect_set("_own").over(same)).select(
        "page_id", "idx", F.col("shown").alias("repaired"), F.col("confidence").alias("raised"),
        F.explode(F.filter("_met", lambda m: (m["_shown"] != F.col("shown")) | (m["_was"] != F.col("confidence")))).alias("m"),
    )
    return met.select("page_id", F.col("m.row").alias("row"), "idx", F.col("m._shown").alias("shown"), "repaired", rounded("raised").alias("confidence"))


# ------------------------------------------------------------------ arbitration

_ARB = """b AS (SELECT p_partkey AS k, substr('1IlO0SsAY47Z2BoLtH-|', CAST(p_partkey % 20 + 1 AS INTEGER), 1) AS label,
    (p_partkey * 37 % 1000) / 1000.0::DOUBLE AS confidence, 10 + p_size AS w, 20 + p_partkey % 50 AS h,
    CASE WHEN p_partkey % 17 = 0 THEN '!' END AS punctuation,
    CASE WHEN p_partkey % 5 <> 0 THEN substr('0oZs', CAST(p_partkey % 4 + 1 AS INTEGER), 1) END AS exemplar_label, (p_partkey % 40)::DOUBLE AS distance,
    CASE WHEN p_partkey % 3 <> 0 THEN substr('HOSILZ', CAST(p_partkey % 6 + 1 AS INTEGER), 1) END AS letter_label, (500 + p_partkey * 13 % 500) / 1000.0::DOUBLE AS letter_confidence,
    CASE WHEN p_partkey % 7 <> 0 THEN substr('0OoSs5Hh1', CAST(p_partkey % 9 + 1 AS INTEGER), 1) END AS alnum_label, (300 + p_partkey * 29 % 700) / 1000.0::DOUBLE AS alnum_confidence,
    CASE WHEN p_partkey % 4 <> 1 THEN CAST(p_partkey % 10 AS VARCHAR) END AS digit_label, (700 + p_partkey * 7 % 300) / 1000.0::DOUBLE AS digit_confidence,
    p_partkey % 13 = 0 AS like_four, p_partkey % 11 = 0 AS like_seven, p_partkey % 8 = 0 AS like_one FROM part)"""


def _arbitration_sql() -> str:
    """One select per step, each written over the label and confidence of the last."""

    alpha, alnum, digit = "regexp_matches({0}, '^[A-Za-z]$')", "regexp_matches({0}, '^[A-Za-z0-9]$')", "regexp_matches({0}, '^[0-9]$')"
    pairs = " OR ".join(
        f"(digit_label = '{d}' AND label = '{c}' AND digit_confidence >= {f} AND confidence < {g})"
        for d, c, f, g in arbitration.DIGIT_OVER_LETTER
    )
    put = "SELECT * EXCLUDE (label, confidence), CASE WHEN {c} THEN {l} ELSE label END AS label, CASE WHEN {c} THEN greatest(confidence, {f}) ELSE confidence END::DOUBLE AS confidence, {c} AS {flag} FROM ({s})"
    plain = "punctuation IS NULL"
    s = "SELECT * FROM b"
    s = put.format(c="(NOT punctuation IS NULL)", l="punctuation", f="0.92", flag="f0", s=s)
    s = f"""SELECT * EXCLUDE (label, confidence, m), CASE WHEN m THEN exemplar_label ELSE label END AS label,
        CASE WHEN m THEN greatest(0.35, least(0.9, 1.0 - distance / 32.0)) ELSE confidence END::DOUBLE AS confidence
        FROM (SELECT *, {plain} AND exemplar_label IS NOT NULL AND confidence < 0.82 AS m FROM ({s}))"""
    s = f"""SELECT *, CASE WHEN lm THEN letter_confidence ELSE 0.0 END AS lc FROM (SELECT *, {plain} AND letter_label IS NOT NULL AND (
        {alpha.format('label')} OR (label IN ('-', '_', '|', '1', 'I', 'l') AND w / h::DOUBLE >= 0.28)
        OR (confidence < 0.82 AND w / h::DOUBLE >= 0.32 AND w * h >= 650)) AS lm FROM ({s}))"""
    twin = f"({alpha.format('label')} AND {alpha.format('alnum_label')} AND lower(label) = lower(alnum_label) AND label <> alnum_label)"
    wins = f"""coalesce({plain} AND alnum_label IS NOT NULL AND CASE WHEN alnum_confidence < 0.55 THEN false
        WHEN {digit.format('alnum_label')} AND lc >= 0.9 THEN false
        WHEN {twin} THEN alnum_confidence >= confidence + CASE WHEN regexp_matches(label, '[a-z]') THEN 0.18::DOUBLE ELSE 0.10::DOUBLE END
        WHEN confidence < 0.86 OR NOT {alnum.format('label')} THEN true
        ELSE (({digit.format('label')} AND {digit.format('alnum_label')}) OR ({alpha.format('label')} AND {alpha.format('alnum_label')}))
          AND alnum_confidence >= confidence - 0.05::DOUBLE END, false)"""
    s = put.format(c=wins, l="alnum_label", f="alnum_confidence", flag="f1", s=s)
    s = f"SELECT *, coalesce({pairs}, false) AS beats FROM ({s})"
    rescue = f"""coalesce({plain} AND digit_label IS NOT NULL AND (NOT {alpha.format('label')} OR confidence < 0.86
        OR label IN ('B', 'I', 'J', 'L', 'O', 'S', 'Y', 'Z', 'l', 'o')) AND w >= 20 AND h >= 34 AND w * h >= 900
        AND digit_confidence >= 0.80 AND (lc < 0.9 OR beats) AND (beats OR NOT {alpha.format('label')} OR confidence < 0.82), false)"""
    s = put.format(c=rescue, l="digit_label", f="digit_confidence", flag="f2", s=s)
    letter = f"""(lm AND NOT f2 AND CASE WHEN NOT {alnum.format('label')} THEN letter_confidence >= 0.55
        WHEN {alpha.format('label')} THEN letter_label = label AND letter_confidence >= 0.70 AND letter_confidence >= confidence - 0.03::DOUBLE
        ELSE letter_confidence >= 0.92 AND letter_confidence >= confidence + 0.08::DOUBLE END)"""
    s = put.format(c=letter, l="letter_label", f="lc", flag="f3", s=s)
    shape = f"""CASE WHEN {plain} THEN CASE WHEN like_four AND label IN ('4', 'A', 'Y') THEN '4'
        WHEN like_seven AND label IN ('1', '7', 'I', 'L', 'l') THEN '7' WHEN like_one AND label IN ('1', 'I', 'L', 'l') THEN '1' END END"""
    s = put.format(c=f"({shape} IS NOT NULL)", l=shape, f="0.92", flag="f4", s=s)
    other = "translate(alnum_label, 'OoSsHh', 'oOsShH')"
    return f"""WITH {_ARB} SELECT k AS region_id, label, round(CASE WHEN {plain} AND alnum_label IS NOT NULL
        AND {alpha.format('alnum_label')} AND least(alnum_confidence, 0.25) >= 0.20 AND label IN (alnum_label, {other})
        THEN CASE WHEN label = alnum_label THEN alnum_confidence ELSE 0.25 END ELSE confidence END, 6) AS confidence FROM ({s})"""


@query("j10_arbitration", _arbitration_sql())
def arbitrate(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda chars: F.substring(F.lit(chars), (k % len(chars) + 1).cast("int"), F.lit(1))
    share = lambda base, step, size: (base + k * step % size) / F.lit(1000.0)
    alnum = F.when(k % 7 != 0, pick("0OoSs5Hh1"))
    regions = T.table(spark, root, "part").select(
        k.alias("region_id"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), (10 + F.col("p_size")).alias("x1"),
        (20 + k % 50).cast("int").alias("y1"), pick("1IlO0SsAY47Z2BoLtH-|").alias("label"), share(0, 37, 1000).alias("confidence"),
    )
    part = T.table(spark, root, "part")
    of = lambda *columns: part.select(k.alias("region_id"), *columns)
    shapes = of(
        F.when(k % 17 == 0, "!").alias("punctuation"), (k % 13 == 0).alias("like_four"),
        (k % 11 == 0).alias("like_seven"), (k % 8 == 0).alias("like_one"),
    )
    exemplars = of(F.when(k % 5 != 0, pick("0oZs")).alias("exemplar_label"), (k % 40).cast("double").alias("distance"))
    letters = of(F.when(k % 3 != 0, pick("HOSILZ")).alias("letter_label"), share(500, 13, 500).alias("letter_confidence"))
    alnums = of(
        alnum.alias("alnum_label"), share(300, 29, 700).alias("alnum_confidence"),
        F.array(
            F.struct(alnum.alias("label"), share(300, 29, 700).alias("confidence")),
            F.struct(F.translate(alnum, "OoSsHh051", "oOsShHabc").alias("label"), F.lit(0.25).alias("confidence")),
        ).alias("alnum_alternatives"),
    )
    digits = of(
        F.when(k % 4 != 1, (k % 10).cast("string")).alias("digit_label"), share(700, 7, 300).alias("digit_confidence")
    )
    scores = arbitration.gather_scores(regions, [shapes, exemplars, letters, alnums, digits])
    return arbitration.arbitrate(scores).select("region_id", "label", rounded("confidence").alias("confidence"))
