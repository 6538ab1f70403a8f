"""Registered queries over the test tables, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def book() -> dict[str, Query]:
    from . import answer_queries, document_queries, price_queries, text_queries

    merged: dict[str, Query] = {}
    for module in (price_queries, text_queries, document_queries, answer_queries):
        for name, query in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = query
    return merged
