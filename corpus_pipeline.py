"""A training corpus from raw documents in five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import neardup, packing, pii, rules, toxicity
from glyphloom.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""

    return rules.with_verdict(docs).filter("kept").select(*COLUMNS)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold under a model of all labelled ones."""

    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=None)
    score = toxicity.score_column(spark, model)
    return docs.filter(score(F.col("text")) < toxicity.THRESHOLD).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word windows, similarity 0.8 or more."""

    classes = neardup.near_duplicates(docs, words=5, percent=80).filter("kept").select("doc_id").distinct()
    rows = docs.join(classes, docs["doc_id"].eqNullSafe(classes["doc_id"]), "left_semi")
    return rows.select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""

    return pii.pseudonymised(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2,048 tokens."""

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", clean_of_toxicity),
    ("near_dedup", one_of_each_group),
    ("pii", pseudonyms),
    ("packing", sequences),
]
ORACLE_SQL = None
"""Trained scores, keyed hashes and tokenizers can't be said in SQL; the tests hold each stage against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; every stage's rows are written to the shared folder and read back."""

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_path(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
