"""Where the catalogs collect their queries and DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def rounded(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


def guesses_text(guesses: Column) -> Column:
    """A guess array as ``label:confidence`` pairs, so that results stay flat."""

    return F.array_join(
        F.transform(guesses, lambda g: F.concat_ws(":", g["label"], F.format_string("%.3f", g["confidence"]))), " "
    )
