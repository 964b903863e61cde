"""Helpers that several operators of this package share."""

from __future__ import annotations

import atexit
import json
import math
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import glyphloom
from glyphloom.session import cut_lineage

SLICE_ROWS = 256
"""Rows of an Arrow batch that become Python objects at once."""


SHIPPED = "glyphloom_package.zip"


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, as Spark does with any Python file."""

    if any(f.endswith(SHIPPED) for f in spark.sparkContext.listFiles):
        return
    package = os.path.dirname(os.path.abspath(glyphloom.__file__))
    folder = tempfile.mkdtemp()  # the driver hands the file out from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{SHIPPED[:-4]}", "zip", os.path.dirname(package), os.path.basename(package)))


def arrow_rows(
    df: DataFrame, columns: list[str], fields: str, rows: Callable[[Iterator[list[tuple]]], Iterator[list[tuple]]]
) -> DataFrame:
    """``df`` through ``rows``, a function over short lists of tuples, without a shuffle.

    ``fields`` is the DDL schema of the tuples it yields. Batches are cut into slices, so a
    batch of very long texts never lives in Python as a whole.
    """

    schema = T.StructType.fromDDL(fields)
    types = [_arrow_type(f.dataType) for f in schema]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[list[tuple]]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    yield list(zip(*(c.to_pylist() for c in part.columns)))

        for out in rows(slices()):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    ship_package(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }[kind.simpleString()]


def bounded_part(df: DataFrame, bound: int, key: Column, total: int | None = None) -> DataFrame:
    """About ``bound`` rows of ``df`` chosen by a hash of ``key``; all of them if there are fewer."""

    total = df.count() if total is None else total
    if total <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(77)), F.lit(1 << 40)) < int(math.ceil(bound / total * (1 << 40))))


def crc_remainder(column: Column, divisor: int) -> Column:
    """crc32 of a number written as text, modulo ``divisor``; null stays null."""

    return F.crc32(column.cast("string").cast("binary")) % divisor


def row_keyed(df: DataFrame, name: str = "row_key") -> DataFrame:
    """``df`` with a unique long per row, written down so that it never changes."""

    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def to_json(value: object) -> str:
    return json.dumps(value, separators=(",", ":"))
