"""Registered queries, each with SQL that DuckDB runs on the same tables where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewell.session import remove, scratch, settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read_back(spark: SparkSession, write, read) -> DataFrame:
    """What read() finds in a new folder after write(); the folder is deleted."""
    path = scratch(spark)
    write(path)
    found = settled(read(path))
    remove(spark, path)
    return found
