"""Queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("p1_lookalike", "p2_near", "p3_markup", "p4_sentences", "p5_reading", "p7_garbled", "p8_packing", "p9_leaks", "p10_spans")


def _each(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        try:
            module = importlib.import_module(f"ledgerlark.llm.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"ledgerlark.llm.{m}":
                raise
            continue
        out |= getattr(module, name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _each("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _each("SQL")
