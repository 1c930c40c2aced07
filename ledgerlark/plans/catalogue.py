"""Named queries over the project's tables, and the SQL each one is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.plans import market_queries, panel_queries, source_queries, text_queries, trailing

MODULES = (text_queries, market_queries, panel_queries, source_queries, trailing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= m.SQL
    return out
