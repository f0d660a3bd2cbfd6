"""Registered queries with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import SQL as VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a function under its name; sql may use the domain's views and start with WITH."""

    def add(function: Query) -> Query:
        if function.__name__ in QUERIES:
            raise ValueError(f"there are two queries called {function.__name__}")
        QUERIES[function.__name__] = function
        if sql:  # without SQL: not expressible
            text = sql.strip()
            ORACLES[function.__name__] = f"WITH RECURSIVE {VIEWS.strip()}" + (", " + text[5:] if text.startswith("WITH ") else " " + text)
        return function

    return add
