"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from glyphloom.llm import rules, toxicity
from test_llm_operators import check_sequences, plain_classes, words

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(docs before, result) of every stage, run one after the other as the pipeline does."""

    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{ROOT}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, ROOT).write.parquet(str(base / name))
        result = spark.read.parquet(str(base / name))
        out[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return out


def test_stages_return_documents(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == corpus_pipeline.COLUMNS, name


def test_quality_stage(stages):
    before, after, _ = stages["quality_rules"]
    every = rules.BASE_RULES + rules.FURTHER_RULES
    assert Counter(after) == Counter(r for r in before if not any(rule.rejects(rules.Stats(r.text)) for rule in every))


def test_toxicity_stage(stages, spark):
    before, after, _ = stages["toxicity"]
    docs = spark.createDataFrame(before)
    scorer = toxicity.Scorer(*toxicity.learn(docs, spark.read.parquet(f"{ROOT}/labels.parquet"), held_out=None))
    assert Counter(after) == Counter(r for r in before if scorer.score(r.text) < toxicity.THRESHOLD)


def test_near_dedup_stage(stages):
    before, after, _ = stages["near_dedup"]
    classes = plain_classes([(r.doc_id, r.text) for r in before], 5, 80)
    assert Counter(r.doc_id for r in after) == Counter(i for i, _, least in classes.elements() if i == least)


def test_pii_and_packing_stages(stages):
    before, after, _ = stages["pii"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert all(r.n_chars == len(r.text) for r in after)
    packed = stages["packing"][1]
    assert {r.doc_id for r in packed} == {r.doc_id for r in after}
    check_sequences([(r.sequence_id, r.offset, r.length) for r in packed])


def test_odd_documents_pass_all_stages(spark, tmp_path):
    rows = [(1, words(1, 80), "en", "s", 1, "x"), (2, words(1, 80), "en", None, None, "x"), (None, words(3, 70), None, "s", 0, "x"), (3, None, "en", "s", 0, "x"), (4, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table, left in ((docs, {1, None}), (docs.limit(0), set())):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, str(tmp_path))
        assert {r.doc_id for r in table.collect()} == left
