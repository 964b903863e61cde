"""Session helpers shared by the bench, the tests and the iterative operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "glyphloom", cpus: str | int = 8, memory: str = "16g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only where none is configured.

    A cluster names a folder every executor can reach in ``spark.checkpoint.dir``.
    Only an unconfigured local session (the tests) falls back to a temporary one,
    which goes when the process ends.
    """

    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix=f"glyphloom-ckpt-{os.getpid()}-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession) -> str:
    """A new path inside the shared checkpoint folder."""

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/glyphloom-{uuid.uuid4().hex}"


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark must not broadcast, whatever it takes the size for.

    Spark plans with the sizes of the files read: it doesn't see that rows are exploded, nor how far
    values are compressed, and so it would send whole tables of pixels or glyphs through the driver.
    """

    return df.hint("merge")


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each worked out once a row.

    Spark puts a column's expression in place of its name wherever a filter moves below, so a chain of
    derived columns is worked out again for each mention; it doesn't do so through a generator.
    """

    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    A lost executor then costs a re-read and not the whole iteration, and later
    joins plan with the table's real size.
    """

    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
