"""The registered queries, each beside the same query in DuckDB's SQL; PLAIN are those that SQL can't express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def plain(f):
    PLAIN[f.__name__] = f
    return f
