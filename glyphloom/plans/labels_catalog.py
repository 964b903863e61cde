"""Queries on labels, curation, matching and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import labels as L
from glyphloom.functions import scores as S
from glyphloom.operators import curate, losses, matching, quality, scoring
from glyphloom.plans import standins as T
from glyphloom.plans.registry import query, rounded
from glyphloom.plans.standins import with_ctes


def _group_sql(e: str, p: str, groups: list[str]) -> str:
    tests = []
    for g in groups:
        g = g.replace("'", "''")
        tests.append(f"(contains('{g}', {e}) AND contains('{g}', {p}))")
    return "(" + " OR ".join(tests) + ")"


def _same_sql(e: str, p: str) -> str:
    return f"(regexp_matches({e}, '^[A-Za-z]$') AND lower({e}) = lower({p}))"


def ambiguous_sql(e: str, p: str, groups: list[str] = L.CHARACTER_GROUPS) -> str:
    return f"({e} = {p} OR {_same_sql(e, p)} OR {_group_sql(e, p, groups)})"


def visual_sql(e: str, p: str) -> str:
    return f"({e} = {p} OR (NOT {_same_sql(e, p)} AND {_group_sql(e, p, L.MIXED_GROUPS)}))"


CHAR_GROUP_SQL = (
    "CASE WHEN regexp_matches({0}, '^[0-9]$') THEN 'digits' WHEN regexp_matches({0}, '^\\p{{L}}+$') THEN 'letters' ELSE 'punctuation' END"
)
CASE_GROUP_SQL = (
    "CASE WHEN regexp_matches({0}, '^[0-9]$') THEN 'digit' WHEN regexp_matches({0}, '\\p{{Lu}}') THEN 'upper' ELSE 'lower' END"
)


def _pct(correct: str, total: str = "count(*)") -> str:
    return f"round(100.0::DOUBLE * {correct} / greatest({total}, 1), 6)"


# ------------------------------------------------------------------ labels


@query(
    "p01_label_groups",
    with_ctes(
        ["preds"],
        f"""SELECT label, {CHAR_GROUP_SQL.format('label')} AS character_group, {CASE_GROUP_SQL.format('label')} AS case_group,
        count(*) AS n FROM preds GROUP BY 1""",
    ),
)
def label_groups(spark: SparkSession, root: str) -> DataFrame:
    counts = T.predictions(spark, root).groupBy("label").agg(F.count("*").alias("n"))
    return counts.select(
        "label", L.character_group(F.col("label")).alias("character_group"),
        L.case_group(F.col("label")).alias("case_group"), "n",
    )


@query(
    "p02_folded_targets",
    """SELECT target, CASE WHEN target >= 36 THEN target - 26 ELSE target END AS folded,
    CASE WHEN target >= 36 THEN 2 WHEN target >= 10 THEN 1 ELSE 0 END AS type_index, count(*) AS n
    FROM (SELECT CAST(p_partkey % 62 AS INTEGER) AS target FROM part) WHERE target >= 10 AND target < 62 GROUP BY target""",
)
def folded_targets(spark: SparkSession, root: str) -> DataFrame:
    samples = T.table(spark, root, "part").select((F.col("p_partkey") % 62).cast("int").alias("target"))
    kept = curate.target_range(samples, 10, 62)
    return kept.groupBy("target").agg(F.count("*").alias("n")).select(
        "target", L.fold_target(F.col("target")).alias("folded"), L.type_index(F.col("target")).alias("type_index"), "n"
    )


@query(
    "p03_ambiguity_match",
    with_ctes(
        ["scored"],
        f"""SELECT sample_id, expected, predicted, {ambiguous_sql('expected', 'predicted')} AS ambiguous,
        {ambiguous_sql('expected', 'predicted', L.MIXED_GROUPS)} AS case_or_visual, {visual_sql('expected', 'predicted')} AS visual
        FROM scored""",
    ),
)
def ambiguity_match(spark: SparkSession, root: str) -> DataFrame:
    e, p = F.col("expected"), F.col("predicted")
    return T.scored_labels(spark, root).select(
        "sample_id", "expected", "predicted", L.matches_ambiguous(e, p).alias("ambiguous"),
        L.matches_ambiguous(e, p, L.MIXED_GROUPS).alias("case_or_visual"), L.matches_visual(e, p).alias("visual"),
    )


_WORD_PAIR = "SELECT page_id, row, word AS target, translate(word, 'oilstTeBg', '01I57+f8') AS prediction, 'font' || (row % 4) AS font FROM words"
_SEQ_MATCH = f"""(target = prediction OR (length(target) = length(prediction) AND
    list_bool_and(list_transform(generate_series(1, length(target)), lambda i: {ambiguous_sql('target[i]', 'prediction[i]')}))))"""


def _word_pairs(spark: SparkSession, root: str) -> DataFrame:
    return T.words(spark, root).select(
        "page_id", "row", F.col("word").alias("target"), F.translate("word", "oilstTeBg", "01I57+f8").alias("prediction"),
        F.concat(F.lit("font"), F.col("row") % 4).alias("font"),
    )


@query(
    "p04_sequence_match",
    with_ctes(
        ["words"],
        f"""SELECT font, matched, count(*) AS n, sum(length(target)) AS chars FROM (
        SELECT *, {_SEQ_MATCH} AS matched FROM ({_WORD_PAIR})) GROUP BY font, matched""",
    ).replace("sum(length(target))", "CAST(sum(length(target)) AS BIGINT)"),
)
def sequence_match(spark: SparkSession, root: str) -> DataFrame:
    judged = _word_pairs(spark, root).withColumn("matched", L.sequence_matches(F.col("target"), F.col("prediction")))
    return judged.groupBy("font", "matched").agg(F.count("*").alias("n"), F.sum(F.length("target")).alias("chars"))


@query(
    "u02_ordered_distinct",
    with_ctes(
        ["words"],
        """SELECT page_id, string_agg(word, ' ' ORDER BY first) AS distinct_words, count(*) AS n FROM (
        SELECT page_id, word, min(row) AS first FROM words GROUP BY 1, 2) GROUP BY page_id""",
    ),
)
def ordered_distinct(spark: SparkSession, root: str) -> DataFrame:
    seen = curate.first_seen(T.words(spark, root), "word", "row", ["page_id"])
    ordered = F.array_sort(F.collect_list(F.struct("first_position", "word")))
    return seen.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("distinct_words"), F.count("*").alias("n")
    )


@query(
    "u03_vocabulary_differences",
    """WITH a AS (SELECT CAST(p_partkey % 62 AS INTEGER) AS idx, chr(CAST(48 + p_partkey % 62 AS INTEGER)) AS label FROM part GROUP BY ALL),
    b AS (SELECT CAST(p_partkey % 60 AS INTEGER) AS idx, CASE WHEN p_partkey % 60 = 7 THEN '?' ELSE chr(CAST(48 + p_partkey % 60 AS INTEGER)) END AS label FROM part GROUP BY ALL)
    SELECT idx, label, 'first' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT idx, label, 'second' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def vocabulary_differences(spark: SparkSession, root: str) -> DataFrame:
    part = T.table(spark, root, "part")

    def vocab(size: int, odd: int | None) -> DataFrame:
        idx = (F.col("p_partkey") % size).cast("int")
        label = F.chr(48 + idx) if odd is None else F.when(idx == odd, "?").otherwise(F.chr(48 + idx))
        return part.select(idx.alias("idx"), label.alias("label")).distinct()

    return curate.vocabulary_differences(vocab(62, None), vocab(60, 7))


# ------------------------------------------------------------------ curation


@query(
    "s05_letters_split_reindex",
    """SELECT CAST(target - 1 + 10 AS INTEGER) AS target, count(*) AS n FROM (SELECT CAST(p_partkey % 27 AS INTEGER) AS target FROM part)
    WHERE target > 0 GROUP BY target""",
)
def letters_split_reindex(spark: SparkSession, root: str) -> DataFrame:
    samples = T.table(spark, root, "part").select((F.col("p_partkey") % 27).cast("int").alias("target"))
    return curate.letters_split_targets(samples, offset=10).groupBy("target").agg(F.count("*").alias("n"))


@query(
    "s06_by_class_fold",
    """SELECT CAST(CASE WHEN t >= 36 THEN t - 26 ELSE t END AS INTEGER) AS target, count(*) AS n
    FROM (SELECT p_partkey % 70 AS t FROM part) WHERE t < 62 GROUP BY 1""",
)
def by_class_fold(spark: SparkSession, root: str) -> DataFrame:
    samples = T.table(spark, root, "part").select((F.col("p_partkey") % 70).cast("int").alias("target"))
    source = L.vocabulary(spark, L.MIXED_LABELS).select("idx", "label")
    folded = curate.fold_source_targets(samples, source, L.vocabulary(spark, L.FOLDED_LABELS).select("idx", "label"))
    return folded.groupBy("target").agg(F.count("*").alias("n"))


@query(
    "s06_by_class_keep",
    "SELECT CAST(p_partkey % 70 AS INTEGER) AS target, count(*) AS n FROM part WHERE p_partkey % 70 < 62 GROUP BY 1",
)
def by_class_keep(spark: SparkSession, root: str) -> DataFrame:
    samples = T.table(spark, root, "part").select((F.col("p_partkey") % 70).cast("int").alias("target"))
    vocab = L.vocabulary(spark, L.MIXED_LABELS).select("idx", "label")
    return curate.keep_source_targets(samples, vocab, vocab).groupBy("target").agg(F.count("*").alias("n"))


@query(
    "v09_cap_per_class",
    with_ctes(
        ["glyphs"],
        """SELECT sample_id, target, md5('1000045|' || sample_id) AS shuffle_key FROM glyphs
        QUALIFY row_number() OVER (PARTITION BY target ORDER BY md5('42|' || sample_id), sample_id) <= 48""",
    ),
)
def cap_per_class(spark: SparkSession, root: str) -> DataFrame:
    capped = curate.cap_per_class(T.glyph_samples(spark, root).drop("vec"), 48, 42)
    return capped.select("sample_id", "target", "shuffle_key")


@query(
    "v10_exemplar_bank",
    with_ctes(["bank"], "SELECT sample_id, target, label, round(list_sum(vec), 6) AS vec_sum FROM bank"),
)
def exemplar_bank(spark: SparkSession, root: str) -> DataFrame:
    bank = curate.exemplar_bank(T.split_samples(spark, root).filter("split = 'train'"))
    return bank.select("sample_id", "target", "label", rounded(S.array_sum(F.col("vec"))).alias("vec_sum"))


@query("v11_stratified_split", with_ctes(["split"], "SELECT sample_id, target, split FROM split"))
def stratified_split(spark: SparkSession, root: str) -> DataFrame:
    return T.split_samples(spark, root).select("sample_id", "target", "split")


@query(
    "u01_source_union",
    with_ctes(
        ["glyphs"],
        """SELECT sample_id, target, 'base' AS source FROM (SELECT * FROM glyphs WHERE source = 'src0'
          QUALIFY row_number() OVER (PARTITION BY target ORDER BY md5('42|' || sample_id), sample_id) <= 12)
        UNION ALL SELECT sample_id, target, 'letters' FROM (SELECT * FROM glyphs WHERE source = 'src1'
          QUALIFY row_number() OVER (PARTITION BY target ORDER BY md5('43|' || sample_id), sample_id) <= 12)
        UNION ALL SELECT sample_id, target, 'extra' FROM glyphs WHERE source = 'src2'""",
    ),
)
def source_union(spark: SparkSession, root: str) -> DataFrame:
    glyphs = T.glyph_samples(spark, root).drop("vec")
    of = lambda name: glyphs.filter(F.col("source") == name).drop("source")
    parts = [
        curate.SourcePart("base", of("src0"), cap=12),
        curate.SourcePart("letters", of("src1"), cap=12, seed_step=1),
        curate.SourcePart("extra", of("src2")),
        curate.SourcePart("unused", of("src0"), enabled=False),
    ]
    return curate.union_sources(parts, 42, ["sample_id", "target"])


@query(
    "a09_sample_weights",
    with_ctes(["glyphs"], "SELECT sample_id, target, round(1.0::DOUBLE / count(*) OVER (PARTITION BY target), 9) AS weight FROM glyphs"),
)
def sample_weights(spark: SparkSession, root: str) -> DataFrame:
    weighted = curate.sample_weights(T.glyph_samples(spark, root).drop("vec"))
    return weighted.select("sample_id", "target", rounded("weight", 9).alias("weight"))


@query(
    "a09_weighted_draw",
    with_ctes(
        ["glyphs"],
        """, c AS (SELECT target, count(*) AS n, row_number() OVER (ORDER BY target) - 1 AS slot, count(*) OVER () AS classes
          FROM glyphs GROUP BY target),
        d AS (SELECT sample_id AS draw_id, ('0x' || substr(md5('7|' || sample_id || '|class'), 1, 15))::BIGINT AS cp,
          ('0x' || substr(md5('7|' || sample_id || '|row'), 1, 15))::BIGINT AS rp FROM glyphs),
        r AS (SELECT sample_id, target, row_number() OVER (PARTITION BY target ORDER BY md5('7|' || sample_id), sample_id) AS rk FROM glyphs)
        SELECT d.draw_id, r.sample_id, r.target FROM d JOIN c ON c.slot = d.cp % c.classes
        JOIN r ON r.target = c.target AND r.rk = d.rp % c.n + 1""",
    ).replace("\n, c AS", ",\nc AS"),
)
def weighted_draw(spark: SparkSession, root: str) -> DataFrame:
    return curate.weighted_draw(T.glyph_samples(spark, root).drop("vec"), 7)


_VOCAB62 = "SELECT i - 1 AS idx, substr('" + "".join(L.MIXED_LABELS) + "', i, 1) AS label FROM range(1, 63) r(i)"


@query(
    "a10_mixed_loss_weights",
    f"""WITH v AS ({_VOCAB62}), n AS (SELECT p_partkey % 59 AS idx, count(*) AS n FROM part GROUP BY 1),
    f AS (SELECT v.idx, label, greatest(coalesce(n.n, 0), 1)::DOUBLE AS n FROM v LEFT JOIN n USING (idx))
    SELECT CAST(idx AS INTEGER) AS idx, label, round((CASE WHEN idx BETWEEN 10 AND 35 THEN 1.2 WHEN idx >= 36 THEN 1.5 ELSE 1.0 END
      * CASE WHEN contains('sO0', label) THEN 2.0 ELSE 1.0 END) * pow((SELECT avg(n) FROM f) / n, 0.5), 6) AS weight FROM f""",
)
def mixed_loss_weights(spark: SparkSession, root: str) -> DataFrame:
    samples = T.table(spark, root, "part").select((F.col("p_partkey") % 59).cast("int").alias("target"))
    weights = curate.mixed_loss_weights(
        L.vocabulary(spark, L.MIXED_LABELS), 1.2, 1.5, "sO0", 2.0, curate.class_counts(samples), 0.5
    )
    return weights.withColumn("weight", rounded("weight"))


@query(
    "a10_character_loss_weights",
    with_ctes(
        ["preds"],
        """SELECT label, CASE WHEN regexp_matches(label, '^[\\p{L}\\p{N}]$') THEN 1.0 ELSE 1.5 END::DOUBLE
        * CASE WHEN contains('s.i', label) THEN 3.0 ELSE 1.0 END::DOUBLE AS weight FROM preds GROUP BY label""",
    ),
)
def character_loss_weights(spark: SparkSession, root: str) -> DataFrame:
    seen = T.predictions(spark, root).select(F.lit(0).alias("idx"), "label").distinct()
    return curate.character_loss_weights(seen, 1.5, "s.i", 3.0).select("label", "weight")


# ------------------------------------------------------------------ matching


@query(
    "j09_nearest_exemplar",
    with_ctes(
        ["scored"],
        """SELECT sample_id, expected, predicted, exemplar_id, round(distance, 6) AS distance,
        CASE WHEN sample_id % 100 / 100.0::DOUBLE < 0.82 THEN predicted ELSE expected END AS label,
        round(CASE WHEN sample_id % 100 / 100.0::DOUBLE < 0.82 THEN greatest(0.35, least(0.9, 1.0::DOUBLE - distance / 32.0))
          ELSE sample_id % 100 / 100.0::DOUBLE END, 6) AS confidence FROM scored""",
    ),
)
def nearest_exemplar(spark: SparkSession, root: str) -> DataFrame:
    matched = T.scored_labels(spark, root).withColumn("exemplar_label", F.col("predicted")).withColumn(
        "label", F.col("expected")
    ).withColumn("confidence", F.col("sample_id") % 100 / F.lit(100.0))
    return matching.apply_fallback(matched).select(
        "sample_id", "expected", "predicted", "exemplar_id", rounded("distance").alias("distance"), "label",
        rounded("confidence").alias("confidence"),
    )


# ------------------------------------------------------------------ quality


@query(
    "a01_loss_and_accuracy",
    with_ctes(
        ["scored"],
        f"""SELECT round(avg(loss), 6) AS loss, {_pct('sum(ok)', 'sum(n)')} AS accuracy, CAST(sum(n) AS BIGINT) AS total FROM (
        SELECT batch_id, avg(distance) AS loss, count(*) FILTER (expected = predicted) AS ok, count(*) AS n FROM scored GROUP BY 1)""",
    ),
)
def loss_and_accuracy(spark: SparkSession, root: str) -> DataFrame:
    scored = T.scored_labels(spark, root).withColumn("correct", F.col("expected") == F.col("predicted"))
    out = quality.evaluation(scored, loss="distance")
    return out.select(rounded("loss").alias("loss"), rounded("accuracy").alias("accuracy"), "total")


def _flt(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


_AMB = ambiguous_sql("expected", "predicted")
_CG = CHAR_GROUP_SQL.format("expected")
_MG = CASE_GROUP_SQL.format("expected")


@query(
    "a02_character_breakdown",
    with_ctes(
        ["scored"],
        f"""SELECT {_pct(_flt('exact'))} AS validation_accuracy, {_pct(_flt('amb'))} AS ambiguity_aware_validation_accuracy,
        {_pct(_flt("exact AND g = 'digits'"), _flt("g = 'digits'"))} AS digit_validation_accuracy,
        {_pct(_flt("exact AND g = 'letters'"), _flt("g = 'letters'"))} AS letter_validation_accuracy,
        {_pct(_flt("exact AND g = 'punctuation'"), _flt("g = 'punctuation'"))} AS punctuation_validation_accuracy,
        {_pct(_flt("amb AND g = 'punctuation'"), _flt("g = 'punctuation'"))} AS punctuation_ambiguity_aware_validation_accuracy
        FROM (SELECT expected = predicted AS exact, {_AMB} AS amb, {_CG} AS g FROM scored)""",
    ),
)
def character_breakdown(spark: SparkSession, root: str) -> DataFrame:
    out = quality.character_breakdown(T.scored_labels(spark, root))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


def _mixed_sql() -> str:
    parts = []
    for suffix, flag in (
        ("test_accuracy", "exact"), ("ambiguity_aware_test_accuracy", "vis"),
        ("case_or_ambiguity_aware_test_accuracy", "cov"),
    ):
        for g in ("digit", "upper", "lower"):
            cond = f"{flag} AND g = '{g}'"
            total = f"g = '{g}'"
            parts.append(f"{_pct(_flt(cond), _flt(total))} AS {g}_{suffix}")
    return ", ".join(parts)


@query(
    "a03_mixed_breakdown",
    with_ctes(
        ["scored"],
        f"""SELECT {_pct(_flt('exact'))} AS test_accuracy, {_pct(_flt('cf'))} AS casefold_test_accuracy,
        {_pct(_flt('vis'))} AS ambiguity_aware_test_accuracy, {_pct(_flt('cov'))} AS case_or_ambiguity_aware_test_accuracy,
        {_mixed_sql()} FROM (SELECT expected = predicted AS exact, expected = predicted OR {_same_sql('expected', 'predicted')} AS cf,
        {visual_sql('expected', 'predicted')} AS vis, {ambiguous_sql('expected', 'predicted', L.MIXED_GROUPS)} AS cov,
        {_MG} AS g FROM scored)""",
    ),
)
def mixed_breakdown(spark: SparkSession, root: str) -> DataFrame:
    out = quality.mixed_breakdown(T.scored_labels(spark, root))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


_ACC_SQL = f"""SELECT expected AS label, count(*) FILTER (expected = predicted) AS correct, count(*) AS total,
    {_pct('count(*) FILTER (expected = predicted)')} AS accuracy FROM scored GROUP BY 1"""


def _accuracies(spark: SparkSession, root: str) -> DataFrame:
    out = quality.label_accuracy(T.scored_labels(spark, root))
    return out.withColumn("accuracy", rounded("accuracy"))


@query("a04_label_accuracy", with_ctes(["scored"], _ACC_SQL))
def label_accuracy(spark: SparkSession, root: str) -> DataFrame:
    return _accuracies(spark, root)


_CONF_SQL = f"SELECT expected, predicted, count(*) AS count, {_CG} AS grp FROM scored WHERE expected <> predicted GROUP BY 1, 2"


@query("a05_confusions", with_ctes(["scored"], _CONF_SQL))
def confusions(spark: SparkSession, root: str) -> DataFrame:
    return quality.confusions(T.scored_labels(spark, root))


@query(
    "a06_confusion_report",
    with_ctes(
        ["scored"],
        f"""SELECT CASE grouping(grp, label) WHEN 0 THEN 'label' WHEN 1 THEN 'group' ELSE 'total' END AS level, grp, label,
        count(*) AS total, count(*) FILTER (exact) AS correct, {_pct('count(*) FILTER (exact)')} AS exact_accuracy,
        {_pct('count(*) FILTER (amb)')} AS ambiguity_aware_accuracy FROM (
        SELECT expected AS label, {_CG} AS grp, expected = predicted AS exact, {_AMB} AS amb FROM scored)
        GROUP BY GROUPING SETS ((), (grp), (grp, label))""",
    ),
)
def confusion_report(spark: SparkSession, root: str) -> DataFrame:
    out = quality.confusion_report(T.scored_labels(spark, root))
    return out.withColumns({c: rounded(c) for c in ("exact_accuracy", "ambiguity_aware_accuracy")})


@query("t01_top_confusions", with_ctes(["scored"], _CONF_SQL + " ORDER BY count DESC, expected, predicted LIMIT 25"))
def top_confusions(spark: SparkSession, root: str) -> DataFrame:
    return quality.top_confusions(quality.confusions(T.scored_labels(spark, root)))


@query(
    "t01_top_confusions_by_group",
    with_ctes(
        ["scored"],
        f"SELECT * FROM ({_CONF_SQL}) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count DESC, expected, predicted) <= 5",
    ),
)
def top_confusions_by_group(spark: SparkSession, root: str) -> DataFrame:
    return quality.top_confusions_by_group(quality.confusions(T.scored_labels(spark, root)), 5)


@query("t02_worst_labels", with_ctes(["scored"], _ACC_SQL + " ORDER BY accuracy, label LIMIT 4"))
def worst_labels(spark: SparkSession, root: str) -> DataFrame:
    return quality.worst_labels(_accuracies(spark, root), 4)


@query(
    "a07_hard_case_report",
    with_ctes(
        ["words"],
        f"""SELECT font, CASE WHEN grouping(font) = 1 THEN 'all' ELSE 'font' END AS scope, count(*) AS total,
        count(*) FILTER (target = prediction) AS exact_correct, {_pct('count(*) FILTER (target = prediction)')} AS exact_accuracy,
        count(*) FILTER (aware) AS ambiguity_aware_correct, {_pct('count(*) FILTER (aware)')} AS ambiguity_aware_accuracy
        FROM (SELECT *, {_SEQ_MATCH} AS aware FROM ({_WORD_PAIR})) GROUP BY ROLLUP (font)""",
    ),
)
def hard_case_report(spark: SparkSession, root: str) -> DataFrame:
    out = quality.hard_case_report(_word_pairs(spark, root))
    return out.withColumns({c: rounded(c) for c in ("exact_accuracy", "ambiguity_aware_accuracy")})


@query(
    "a17_hard_case_gates",
    with_ctes(
        ["words"],
        f"""SELECT name, value, 95.0::DOUBLE AS target, value >= 95.0 AS passed, correct, total FROM (
        SELECT 'app_hardcase_exact' AS name, {_pct('count(*) FILTER (target = prediction)')} AS value,
          count(*) FILTER (target = prediction) AS correct, count(*) AS total FROM ({_WORD_PAIR})
        UNION ALL SELECT 'app_hardcase_ambiguity', {_pct('count(*) FILTER (aware)')}, count(*) FILTER (aware), count(*)
          FROM (SELECT *, {_SEQ_MATCH} AS aware FROM ({_WORD_PAIR})))""",
    ),
)
def hard_case_gates(spark: SparkSession, root: str) -> DataFrame:
    out = quality.hard_case_gates(quality.hard_case_report(_word_pairs(spark, root)))
    return out.withColumn("value", rounded("value"))


# ------------------------------------------------------------------ metric histories


@query(
    "a16_best_checkpoint",
    with_ctes(
        ["history"],
        """SELECT model, epoch, round(test_accuracy, 6) AS test_accuracy FROM history
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY coalesce(test_accuracy, 0) DESC, epoch) = 1""",
    ),
)
def best_checkpoint(spark: SparkSession, root: str) -> DataFrame:
    history = T.metric_history(spark, root).withColumn("position", F.col("epoch"))
    best = quality.best_checkpoint(history, "test_accuracy", ["model"])
    return best.select("model", "epoch", rounded("test_accuracy").alias("test_accuracy"))


_MODEL_OF = {"1-URGENT": "digit", "2-HIGH": "folded", "3-MEDIUM": "mixedcase", "5-LOW": "character"}


@query(
    "a17_quality_gates",
    with_ctes(
        ["history"],
        """, best AS (SELECT CASE model WHEN '1-URGENT' THEN 'digit' WHEN '2-HIGH' THEN 'folded' WHEN '3-MEDIUM' THEN 'mixedcase'
          WHEN '5-LOW' THEN 'character' END AS model, max(test_accuracy) + 40 AS value FROM history GROUP BY 1),
        gates AS (SELECT * FROM (VALUES ('digit_specialist_exact', 'digit', 1), ('folded_alnum_exact', 'folded', 1),
          ('mixedcase_exact', 'mixedcase', 1), ('mixedcase_case_or_visual', 'mixedcase', 0), ('character_exact', 'character', 0),
          ('character_ambiguity', 'character', 0), ('punctuation_exact', 'character', 0), ('punctuation_ambiguity', 'character', 0)) g(name, model, has))
        SELECT name, round(CASE WHEN has = 1 THEN value END, 6) AS value, 95.0::DOUBLE AS target,
        coalesce(CASE WHEN has = 1 THEN value END >= 95.0, false) AS passed FROM gates LEFT JOIN best USING (model)""",
    ).replace("\n, best AS", ",\nbest AS"),
)
def quality_gates(spark: SparkSession, root: str) -> DataFrame:
    names = F.create_map(*[F.lit(v) for pair in _MODEL_OF.items() for v in pair])
    history = T.metric_history(spark, root).withColumn("position", F.col("epoch"))
    best = quality.best_checkpoint(history, "test_accuracy", ["model"])
    metrics = best.select(
        names[F.col("model")].alias("model"), F.lit("test_accuracy").alias("metric"), (F.col("test_accuracy") + 40).alias("value")
    )
    return quality.quality_gates(quality.gate_definitions(spark), metrics).withColumn("value", rounded("value"))


@query(
    "v12_training_progress",
    with_ctes(
        ["history"],
        """SELECT model, epoch, round(test_accuracy, 6) AS test_accuracy,
        round(max(test_accuracy) OVER (PARTITION BY model ORDER BY epoch), 6) AS best_so_far,
        coalesce(test_accuracy > max(test_accuracy) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved,
        round(train_accuracy - test_accuracy, 6) AS overfit_gap,
        min(CASE WHEN test_accuracy >= 50 AND epoch >= 8 THEN epoch END) OVER (PARTITION BY model) AS stop_epoch FROM history""",
    ),
)
def training_progress(spark: SparkSession, root: str) -> DataFrame:
    out = quality.training_progress(T.metric_history(spark, root), "test_accuracy", "train_accuracy", 50.0)
    return out.withColumns({c: rounded(c) for c in ("test_accuracy", "best_so_far", "overfit_gap")})


# ------------------------------------------------------------------ score vectors

_SCORES = """s AS (SELECT vec_id AS sample_id, label AS target, i - 1 AS i, v * 10 AS v FROM (SELECT vec_id, label,
    unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE i <= {n})"""


@query(
    "p12_score_folding",
    f"""WITH {_SCORES.format(n=62)}, f AS (SELECT sample_id, CASE WHEN i >= 36 THEN i - 26 ELSE i END AS k, ln(sum(exp(v))) AS v FROM s GROUP BY 1, 2),
    t AS (SELECT sample_id, ln(sum(exp(v)) FILTER (i < 10)) AS digit, ln(sum(exp(v)) FILTER (i BETWEEN 10 AND 35)) AS upper,
      ln(sum(exp(v)) FILTER (i >= 36)) AS lower FROM s GROUP BY 1)
    SELECT sample_id, round(sum(v * (k + 1)), 6) AS folded_check, count(*) AS folded_size, round(any_value(digit), 6) AS digit,
    round(any_value(upper), 6) AS upper, round(any_value(lower), 6) AS lower FROM f JOIN t USING (sample_id) GROUP BY sample_id""",
)
def score_folding(spark: SparkSession, root: str) -> DataFrame:
    folded = T.score_vectors(spark, root, 62).withColumn("f", S.fold_case_scores(F.col("scores"))).withColumn(
        "t", S.type_scores(F.col("scores"))
    )
    weighted = S.array_sum(F.transform("f", lambda v, i: v * (i + 1)))
    return folded.select(
        "sample_id", rounded(weighted).alias("folded_check"), F.size("f").cast("long").alias("folded_size"),
        *[rounded(F.get("t", F.lit(i))).alias(n) for i, n in enumerate(("digit", "upper", "lower"))],
    )


@query(
    "p13_top_guesses_from_scores",
    f"""WITH {_SCORES.format(n=64)}, p AS (SELECT sample_id, i, exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w) AS p
    FROM s WINDOW w AS (PARTITION BY sample_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, i) AS k FROM p)
    SELECT sample_id, CAST(k AS INTEGER) AS k, chr(CAST(33 + i AS INTEGER)) AS label, round(p, 6) AS confidence FROM r WHERE k <= 5""",
)
def top_guesses_from_scores(spark: SparkSession, root: str) -> DataFrame:
    labels = F.array(*[F.lit(v) for v in T.SCORE_LABELS])
    top = T.score_vectors(spark, root, 64).select(
        "sample_id", F.posexplode(S.top_guesses_from_scores(F.col("scores"), labels)).alias("k", "g")
    )
    return top.select("sample_id", (F.col("k") + 1).alias("k"), "g.label", rounded("g.confidence").alias("confidence"))


@query(
    "a23_loss_aggregates",
    f"""WITH {_SCORES.format(n=62)}, lp AS (SELECT sample_id, target, i, v - ln(sum(exp(v)) OVER (PARTITION BY sample_id)) AS lp,
      CASE WHEN i % 2 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM s),
    r AS (SELECT sample_id, 0.95::DOUBLE * max(CASE WHEN i = target THEN -lp * w END) + 0.05::DOUBLE * (-sum(lp * w) / 62) AS ce,
      max(CASE WHEN i = target THEN w END) AS w, pow(1 - greatest(max(CASE WHEN i = target THEN exp(lp) END), 1e-6), 2.0) AS f,
      -ln(sum(CASE WHEN (CASE WHEN i >= 36 THEN i - 26 ELSE i END) = target THEN exp(lp) END)) AS fold,
      -ln(sum(CASE WHEN i < 10 THEN exp(lp) END)) AS type FROM lp GROUP BY sample_id)
    SELECT round(avg(f * ce), 6) AS focal_loss, round(sum(ce) / sum(w), 6) AS weighted_loss,
    round(0.5::DOUBLE * avg(fold) + 0.25::DOUBLE * avg(type), 6) AS auxiliary_loss FROM r""",
)
def loss_aggregates(spark: SparkSession, root: str) -> DataFrame:
    weights = F.array(*[F.lit(1.5 if i % 2 == 0 else 1.0) for i in range(62)])
    scored = T.score_vectors(spark, root, 62)
    out = losses.loss_report(scored, weights, smoothing=0.05, gamma=2.0, folded_weight=0.5, type_weight=0.25)
    return out.select(*[rounded(c).alias(c) for c in out.columns])


# ------------------------------------------------------------------ scorers


@query(
    "f01_pluggable_scorer",
    f"""WITH {_SCORES.format(n=64)}, p AS (SELECT sample_id, i, v, sum(exp(v)) OVER (PARTITION BY sample_id) AS z FROM s)
    SELECT sample_id AS region_id, chr(CAST(33 + i AS INTEGER)) AS label, round(exp(v) / z, 6) AS confidence FROM p
    QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, i) = 1""",
)
def pluggable_scorer(spark: SparkSession, root: str) -> DataFrame:
    samples = T.glyph_samples(spark, root).select(F.col("sample_id").alias("region_id"), "vec")
    scored = scoring.score_vectors(samples, lambda block: block * 10.0)
    labels = F.array(*[F.lit(v) for v in T.SCORE_LABELS])
    best = F.get(S.top_guesses_from_scores(F.col("scores"), labels, 1), F.lit(0))
    return scored.select("region_id", best["label"].alias("label"), rounded(best["confidence"]).alias("confidence"))


@query("f02_baseline_classifier")
def baseline_classifier(spark: SparkSession, root: str) -> DataFrame:
    samples = T.split_samples(spark, root)
    train, validation = samples.filter("split = 'train'"), samples.filter("split = 'validation'")
    model = scoring.train_baseline(train, classes=10, hidden=[16, 12], iterations=20)
    out = scoring.baseline_predictions(model, validation)
    return out.groupBy("target").agg(
        F.count("*").alias("total"), F.count_if(F.col("target") == F.col("predicted_target")).alias("correct")
    )


# ------------------------------------------------------------------ flagship


@query(
    "flagship_confused_pairs",
    with_ctes(
        ["scored"],
        f"""SELECT expected, predicted, {_CG} AS grp, count(*) AS count, {_AMB} AS lookalike,
        round(avg(distance), 6) AS mean_distance FROM scored WHERE expected <> predicted GROUP BY 1, 2
        ORDER BY count DESC, expected, predicted LIMIT 25""",
    ),
)
def confused_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Which label pairs are confused most, and is the mistake only a visual twin?"""

    wrong = T.scored_labels(spark, root).filter(F.col("expected") != F.col("predicted"))
    pairs = wrong.groupBy("expected", "predicted").agg(
        F.count("*").alias("count"), rounded(F.avg("distance")).alias("mean_distance")
    )
    named = pairs.select(
        "expected", "predicted", L.character_group(F.col("expected")).alias("grp"), "count",
        L.matches_ambiguous(F.col("expected"), F.col("predicted")).alias("lookalike"), "mean_distance",
    )
    return quality.top_confusions(named)
