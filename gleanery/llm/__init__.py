"""Operators for curating text at corpus scale. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from gleanery.llm import boilerplate, capping, language, neardup, packing, repeated_lines, residue, tokens, truncation

    return [language, boilerplate, residue, capping, neardup, repeated_lines, tokens, packing, truncation]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "SQL", {}).items()}
