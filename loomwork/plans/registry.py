"""What __spark_entry__ registers from the library outside the llm subpackage."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("analytics", "timelines", "reconciling", "scoring", "deduping", "lifecycle", "graphs", "behaviour", "searching", "ingesting", "texts", "extracting", "evaluating", "streams")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its name, with the DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        if importlib.util.find_spec(f"loomwork.plans.{m}"):
            importlib.import_module(f"loomwork.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rrf_hybrid"](spark, sf_dir)
