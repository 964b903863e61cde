"""Labelled image folders: the label is in the path, and files are listed before they are read."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.functions.ranking import hashed_top, seeded_hash
from glyphloom.session import cut_lineage

# --- fixed values -------------------------------------------------------------------
IMAGE_SUFFIXES = ["bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
HEX_ROOT = "by_class"
HEX_SAMPLES_PER_CLASS = 1200
REPORTED_BAD_FOLDERS = 8
MAX_CODE_POINT = 0x10FFFF

TASK_BYTES, TASK_FILES = 128 << 20, 5_000
"""Bytes and files that one task opens, about."""
BATCH_BYTES = 16 << 20
"""Bytes of file contents that a task hands on at once."""
LISTED_ROWS = 50_000
"""Entries of a folder that a task hands on at once."""


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` without its content: (path, length, rel).

    ``rel`` is what follows the root, cut by the root's length as the file system writes
    it, so URIs, relative and dotted roots and folders named like the root all work. A
    path elsewhere is an error. Empty files aren't listed, as Spark's scans leave them out.
    The listing is Spark's own and passes through the driver; see :func:`list_in_tasks`.
    """

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = qualified(spark, root).rstrip("/") + "/"
    outside = F.raise_error(F.concat(F.lit(f"not under {base}: "), F.col("path")))
    rel = F.when(F.startswith("path", F.lit(base)), F.substr("path", F.lit(len(base) + 1))).otherwise(outside)
    return listed.select("path", "length", rel.alias("rel"))


def _lists_folder(uri: str) -> bool:
    try:
        store, inside = store_of(uri)
        return store.get_file_info(inside).type == pafs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        return False


def list_in_tasks(spark: SparkSession, root: str) -> DataFrame:
    """What :func:`list_files` returns, by one job for each level of folders; a folder is listed by the task that has it.

    So the driver never holds the listing. Only a store that pyarrow doesn't reach is listed by Spark.
    """

    top = qualified(spark, root)
    if not _lists_folder(top):
        return list_files(spark, root)
    base = top.rstrip("/") + "/"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (path for batch in batches for path in batch.column("path").to_pylist()):
            store, inside = store_of(folder)
            found = [f for f in store.get_file_info(pafs.FileSelector(inside)) if _is_listed(f)]
            for start in range(0, len(found), LISTED_ROWS):
                part = found[start : start + LISTED_ROWS]
                paths = [f"{folder.rstrip('/')}/{f.base_name}" for f in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(paths, pa.string()), pa.array([f.size for f in part], pa.int64()), pa.array([f.type == pafs.FileType.Directory for f in part])],
                    names=["path", "length", "is_folder"],
                )

    folders = spark.createDataFrame([(top,)], "path string")
    levels: list[DataFrame] = []
    while not folders.isEmpty():
        dealt = folders.repartition(spark.sparkContext.defaultParallelism, "path")
        level = cut_lineage(dealt.mapInArrow(listed, "path string, length long, is_folder boolean"))
        levels.append(level.filter("not is_folder"))
        folders = level.filter("is_folder").select("path")
    files = reduce(DataFrame.unionByName, levels)
    return files.select("path", "length", F.substr("path", F.lit(len(base) + 1)).alias("rel"))


def _is_listed(found: pafs.FileInfo) -> bool:
    """Whether Spark's scans see a file or walk a folder of this name."""

    name = found.base_name
    hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    if found.type == pafs.FileType.Directory:
        return not hidden or name.startswith(("_common_metadata", "_metadata"))
    return found.type == pafs.FileType.File and found.size > 0 and not hidden


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as Spark's listings write paths: with scheme, absolute, without dots."""

    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.getFileStatus(store.resolvePath(store.makeQualified(path))).getPath().toString()


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path inside. Hadoop writes local URIs with one slash and none escaped."""

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest if scheme == "file" else uri).lstrip("/")
    authority, _, inside = rest.removeprefix("//").partition("/")
    store, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, base.rstrip("/") + "/" + inside


def read_bytes(uri: str) -> bytes:
    store, inside = store_of(uri)
    with store.open_input_stream(inside) as stream:
        return stream.read()


def read_files(chosen: DataFrame, read: Callable[[str], bytes] = read_bytes) -> DataFrame:
    """``chosen`` with the ``content`` of each ``path``, opened in the task that has the row.

    Only chosen files are opened, nothing is listed again and no content is shuffled: paths are
    dealt first, over as many tasks as their bytes (``length``, if it is there) fill. A file that
    can't be read ends the job with its path. ``read`` opens a path where the store is one that
    only the caller knows.
    """

    sizes = chosen.agg(F.count("*").alias("n"), *([F.sum("length").alias("bytes")] if "length" in chosen.columns else [])).first().asDict()
    tasks = max(1, math.ceil((sizes.get("bytes") or 0) / TASK_BYTES), math.ceil(sizes["n"] / TASK_FILES))
    schema = T.StructType([*chosen.schema, T.StructField("content", T.BinaryType())])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, contents, held = 0, [], 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    contents.append(read(path))
                except OSError as error:
                    raise OSError(f"cannot read {path}: {error}") from error
                held += len(contents[-1])
                if held >= BATCH_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                    start, contents, held = k + 1, [], 0

    return chosen.repartition(tasks, "path").mapInArrow(opened, schema)


def write_files(files: DataFrame, root: str) -> int:
    """Write each row's ``content`` to ``rel`` below ``root``; how many files there are now.

    A file gets its name once it is whole, so a task that runs twice or is lost leaves no half file.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, content in zip(batch.column("rel").to_pylist(), batch.column("content").to_pylist()):
                store, inside = store_of(f"{root.rstrip('/')}/{rel}")
                folder, _, name = inside.rpartition("/")
                store.create_dir(folder, recursive=True)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as stream:
                    stream.write(content)
                store.move(part, inside)
            yield pa.RecordBatch.from_arrays([batch.column("rel")], names=["rel"])

    return files.select("rel", "content").mapInArrow(written, "rel string").count()


def has_image_suffix(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + r")$")


def top_folder(rel: Column) -> Column:
    """First folder of a relative path, empty for a file at the root."""

    return F.regexp_extract(rel, r"^([^/]+)/", 1)


# ---------------------------------------------------------------- folder = label


def labelled_folders(paths: DataFrame, vocab: DataFrame) -> DataFrame:
    """(path, label_folder, target): the class folder matched without regard to case.

    Unknown folders come with a null target; see :func:`require_known_folders`.
    """

    keys = vocab.groupBy(F.upper("label").alias("_key")).agg(F.max("idx").alias("target"))
    images = paths.withColumn("label_folder", top_folder(F.col("rel"))).filter("label_folder <> ''")
    return (
        images.withColumn("_key", F.upper("label_folder"))
        .join(keys, "_key", "left")
        .filter(F.col("target").isNull() | has_image_suffix(F.col("rel")))
        .select("path", "label_folder", "target")
    )


def require_known_folders(found: DataFrame) -> DataFrame:
    """Fail with all unknown class folders in one sorted message, or on no images."""

    bad = found.filter("target is null").agg(
        F.array_join(F.array_sort(F.collect_set("label_folder")), ", ").alias("names")
    ).first()["names"]
    if bad:
        raise ValueError(f"Extra dataset contains unsupported class folders: {bad}")
    if found.isEmpty():
        raise ValueError("Extra dataset contains no supported images")
    return found


def load_labelled_folder(spark: SparkSession, root: str, vocab: DataFrame) -> DataFrame:
    return require_known_folders(labelled_folders(list_in_tasks(spark, root), vocab))


# ---------------------------------------------------------------- folder = code point


def code_folders(paths: DataFrame) -> DataFrame:
    """(path, rel, folder, code, label): ``65/x.png`` is ``A``; code is null on other folders."""

    folder = top_folder(F.col("rel"))
    letter = F.decode(F.unhex(F.lpad(F.hex("code"), 8, "0")), "UTF-32")
    return (
        paths.withColumn("folder", folder)
        .filter("folder <> ''")
        .withColumn("code", F.when(F.col("folder").rlike(r"^\d{1,9}$"), F.col("folder").try_cast("int")))
        .withColumn("label", F.when(F.col("code").between(1, MAX_CODE_POINT), letter))
    )


def _direct_png(rel: Column) -> Column:
    return rel.rlike(r"^[^/]+/[^/]+\.png$")


def base_code_samples(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base root: other folders are ignored and the vocabulary is discovered.

    Returns (samples, vocabulary); targets count the codes in numeric order.
    """

    coded = code_folders(paths).filter("code is not null")
    # One row per folder name, so a single ordered pass is small.
    vocab = coded.select("code", "label").distinct().withColumn(
        "idx", (F.dense_rank().over(W.orderBy("code")) - 1).cast("int")
    )
    samples = coded.filter(_direct_png(F.col("rel"))).join(
        vocab.select("code", F.col("idx").alias("target")), "code"
    )
    return samples.select("path", "label", "target"), vocab.select("idx", "label")


def extra_code_samples(paths: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extra root: (samples, bad folders). Labels outside the vocabulary are skipped."""

    coded = code_folders(paths)
    bad = coded.filter("code is null").select("folder").distinct()
    samples = coded.filter(_direct_png(F.col("rel"))).join(
        vocab.select("label", F.col("idx").alias("target")), "label"
    )
    return samples.select("path", "label", "target"), bad


def require_code_folders(bad: DataFrame) -> None:
    """Fail naming the first eight folders that are no code points."""

    names = [r["folder"] for r in bad.orderBy("folder").limit(REPORTED_BAD_FOLDERS).collect()]
    if names:
        raise ValueError("Extra character dataset has non-ASCII-code folders: " + ", ".join(names))


def mixed_code_samples(paths: DataFrame, vocab: DataFrame) -> DataFrame:
    """Mixed-case extra root: any image suffix, any depth; fails on the first bad folder."""

    coded = code_folders(paths)
    first = coded.filter("code is null").agg(F.min("folder").alias("f")).first()["f"]
    if first:
        raise ValueError(f"Mixed-case extra dataset contains non-ASCII-code folder: {first}")
    samples = coded.filter(has_image_suffix(F.col("rel"))).join(
        vocab.select("label", F.col("idx").alias("target")), "label"
    )
    return samples.select("path", "label", "target")


# ---------------------------------------------------------------- folder = hex code


def mixed_target(code: Column) -> Column:
    """Code point to the position among 0-9, A-Z, a-z; null otherwise."""

    return (
        F.when(code.between(48, 57), code - 48)
        .when(code.between(65, 90), code - 55)
        .when(code.between(97, 122), code - 61)
    )


def hex_samples(paths: DataFrame) -> DataFrame:
    """(path, rel, target), and length if given, of ``by_class/<hex>/.../*.png`` with at least four parts."""

    parts = F.split("rel", "/")
    hex_code = F.get(parts, F.lit(1))
    code = F.when(hex_code.rlike(r"^[0-9A-Fa-f]{1,6}$"), F.conv(hex_code, 16, 10).cast("int"))
    return (
        paths.filter(F.lower("rel").endswith(".png") & (F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == HEX_ROOT))
        .withColumn("target", mixed_target(code))
        .filter("target is not null")
        .select("path", "rel", "target", *[c for c in ("length",) if c in paths.columns])
    )


def balanced_hex_samples(paths: DataFrame, n: int = HEX_SAMPLES_PER_CLASS, seed: int = 42) -> DataFrame:
    """A seeded draw of ``n`` paths per class, made before any content is read. The root has no part in the draw."""

    return hashed_top(hex_samples(paths), ["target"], seeded_hash(seed, F.col("rel")), "rel", n)


def load_hex_samples(spark: SparkSession, root: str, n: int = HEX_SAMPLES_PER_CLASS, seed: int = 42) -> DataFrame:
    """(path, rel, target, content) of the drawn files; no other file is opened."""

    chosen = cut_lineage(balanced_hex_samples(list_in_tasks(spark, root), n, seed))
    return read_files(chosen).drop("length")


# ---------------------------------------------------------------- folder = sample number


def sample_number(rel: Column) -> Column:
    return F.regexp_extract(top_folder(rel), r"^(?:Sample)?0*(\d{1,9})$", 1).try_cast("int")


def numbered_samples(paths: DataFrame, fold_case: bool = True) -> DataFrame:
    """(path, target) of ``SampleNNN``: 1-10 digits, 11-36 upper, 37-62 lower case.

    Folded targets put both cases on one label; the others keep 62.
    """

    n = sample_number(F.col("rel"))
    lower = n - 27 if fold_case else n - 1
    target = F.when(n.between(1, 36), n - 1).when(n.between(37, 62), lower)
    return (
        paths.filter(_direct_png(F.col("rel")))
        .withColumn("target", target)
        .filter("target is not null")
        .select("path", "target")
    )


# ---------------------------------------------------------------- counts, checksums


def exported_crop_counts(paths: DataFrame) -> DataFrame:
    """(label, count) of ``*.png`` under code-point folders."""

    return (
        code_folders(paths)
        .filter(F.col("code").isNotNull() & F.col("rel").endswith(".png"))
        .groupBy("label")
        .agg(F.count("*").alias("count"))
    )


def checksum_errors(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filename, found, expected) where the MD5 differs or the file is missing.

    ``files``: filename, content. ``manifest``: filename, md5.
    """

    digests = files.select("filename", F.md5("content").alias("found"))
    return manifest.join(digests, "filename", "left").filter(~F.col("found").eqNullSafe(F.col("md5"))).select(
        "filename", "found", F.col("md5").alias("expected")
    )


def require_checksums(files: DataFrame, manifest: DataFrame) -> None:
    wrong = checksum_errors(files, manifest).orderBy("filename").limit(1).collect()
    if wrong:
        row = wrong[0]
        raise ValueError(f"{row['filename']} md5 mismatch: got {row['found']}, expected {row['expected']}")
