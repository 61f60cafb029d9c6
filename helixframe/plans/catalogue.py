"""Registered queries: name -> (spark, folder) -> DataFrame, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


from helixframe.plans import alignment_queries, annotation_queries, assembly_queries, extra_queries, format_queries, interval_queries, model_queries, relational_queries, sequence_queries, transcript_queries  # noqa: E402, F401
