"""Registry of named queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SECTIONS = ["source_queries", "artifact_queries", "column_queries", "extract_queries", "posting_queries", "search_queries",
            "resolve_queries", "hierarchy_queries", "log_queries"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for section in SECTIONS:
        importlib.import_module(f"symlake.plans.{section}")
    return dict(QUERIES), dict(ORACLES)
