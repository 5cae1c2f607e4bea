"""Queries over the reference tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from gleanery.plans import crawl, dates, insights, intelligence, pages, quality, reports, search, streams, texts, urls

    return [search, urls, texts, pages, quality, intelligence, insights, reports, crawl, streams, dates]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "SQL", {}).items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_topk"](spark, sf_dir)
