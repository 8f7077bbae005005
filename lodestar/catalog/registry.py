"""Registered queries: a name, a function of (spark, sf_dir), and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shown(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison between engines; sums of doubles depend on their order."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits)
