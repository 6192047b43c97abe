"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.plans.tables import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is tested against brute force instead."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(column: str | Column, name: str) -> Column:
    return F.round(column, 6).alias(name)


def big(column: str | Column, name: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint").alias(name)


def text(column: str | Column, name: str) -> Column:
    return F.array_join(column, " ").alias(name)
