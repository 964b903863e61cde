"""CSV manifests, vocabulary files, metric files and dataset snapshots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.functions.labels import DIGITS, LOWER, UPPER

# --- fixed values: labels a manifest may be cut down to -----------------------------
MANIFEST_ALNUM = DIGITS + UPPER
MANIFEST_ASCII = DIGITS + UPPER + LOWER + "+-/<>[]|"


def manifest_label(latex: Column, mode: str) -> Column:
    """Folder name for a manifest label: folded alphanumeric or decimal code; null drops it."""

    if mode not in ("alnum", "ascii"):
        raise ValueError(f"Unsupported mode: {mode}")
    single = F.length(latex) == 1
    if mode == "alnum":
        return F.when(single & F.lit(MANIFEST_ALNUM).contains(F.upper(latex)), F.upper(latex))
    return F.when(single & F.lit(MANIFEST_ASCII).contains(latex), F.ascii(latex).cast("string"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, symbol_id string, latex string, user_id string").csv(path, header=True)


def manifest_subset(manifest: DataFrame, mode: str) -> DataFrame:
    """(path, label) of the usable manifest rows."""

    return manifest.withColumn("label", manifest_label(F.col("latex"), mode)).filter("label is not null").select(
        "path", "label"
    )


def missing_manifest_files(subset: DataFrame, listing: DataFrame) -> DataFrame:
    """Usable manifest rows whose file (``rel`` of a listing) does not exist."""

    return subset.join(listing.select(F.col("rel").alias("path")), "path", "left_anti")


def write_manifest_subset(subset: DataFrame, files: DataFrame, output: str) -> DataFrame:
    """Write (label, path, content) by label and return (label, count); fails on a missing file.

    ``files``: path (as in the manifest), content.
    """

    missing = subset.join(files.select("path"), "path", "left_anti").orderBy("path").limit(1).collect()
    if missing:
        raise ValueError(f"Missing manifest image: {missing[0]['path']}")
    subset.join(files, "path").write.mode("overwrite").partitionBy("label").parquet(output)
    return subset.groupBy("label").agg(F.count("*").alias("count"))


# ---------------------------------------------------------------- vocabulary files


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, label) from a JSON array; the position is the target index."""

    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "label"))


def vocabulary_json(vocab: DataFrame) -> DataFrame:
    """One row, the labels in index order as a JSON array."""

    ordered = F.array_sort(F.collect_list(F.struct("idx", "label")))
    return vocab.agg(F.to_json(F.transform(ordered, lambda v: v["label"])).alias("value"))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocabulary_json(vocab).coalesce(1).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- metric files

METRIC_VALUES = "map<string,string>"


def read_metric_candidates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, kind, position, metrics) from metric files of either shape.

    A file is a bare list of epochs, or an object with ``history`` and checkpoints.
    Broken or empty files give no rows. ``kind`` is history, best_checkpoint or the
    name of another ``*_best_checkpoint``; a position counts inside its kind.
    """

    raw = spark.read.text(paths, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value"
    )
    return metric_candidates(raw)


def metric_candidates(raw: DataFrame) -> DataFrame:
    """The parsing step of :func:`read_metric_candidates` on (file, value)."""

    keys = F.json_object_keys("value")
    history = F.when(keys.isNull(), F.col("value")).otherwise(F.get_json_object("value", "$.history"))
    epochs = raw.select(
        "file", F.lit("history").alias("kind"),
        F.posexplode(F.from_json(history, "array<string>")).alias("position", "item"),
    )
    named = raw.select("file", "value", F.explode(keys).alias("kind")).filter(
        (F.col("kind") == "best_checkpoint") | F.col("kind").endswith("_best_checkpoint")
    )
    objects = F.from_json("value", "map<string,string>")
    checkpoints = named.select(
        "file", "kind", F.lit(0).alias("position"),
        objects[F.col("kind")].alias("item"),
    )
    return (
        epochs.unionByName(checkpoints)
        .filter(F.json_object_keys("item").isNotNull())
        .select("file", "kind", "position", F.from_json("item", METRIC_VALUES).alias("metrics"))
    )


def metric_roots(raw: DataFrame) -> DataFrame:
    """(file, root): the extra source roots a metrics file recorded."""

    return raw.select("file", F.explode(F.from_json(F.get_json_object("value", "$.extra_roots"), "array<string>")).alias("root"))


def append_history(history: DataFrame, path: str) -> None:
    """Append epoch metrics as Parquet, one folder per model."""

    history.write.mode("append").partitionBy("model").parquet(path)


# ---------------------------------------------------------------- snapshots


def fingerprint(roots: list[str], **parameters: object) -> str:
    """12 hex digits of the ordered roots and whatever else shaped the data."""

    key: object = [roots, parameters] if parameters else roots
    return hashlib.sha1(json.dumps(key, sort_keys=True).encode()).hexdigest()[:12]


def root_fingerprints(roots: DataFrame, keys: list[str]) -> DataFrame:
    """The same key for many root lists kept in a table: (keys, fingerprint)."""

    ordered = F.array_sort(F.collect_list(F.struct("position", "root")))
    return roots.groupBy(*keys).agg(
        F.substring(F.sha1(F.to_json(F.transform(ordered, lambda r: r["root"]))), 1, 12).alias("fingerprint")
    )


def snapshot(spark: SparkSession, base: str, key: str, build) -> DataFrame:
    """Read the Parquet snapshot ``base/key`` or build and write it first."""

    path = f"{base.rstrip('/')}/{key}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):  # absent or half written
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


GLYPH_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
    ]
)
