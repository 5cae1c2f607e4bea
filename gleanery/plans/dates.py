"""Queries over document dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.functions.timestamps import normalize_document_dates
from gleanery.session import load


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC moment of every published_date and modified_date of processed_docs."""
    return normalize_document_dates(load(spark, sf_dir, "processed_docs"), load(spark, sf_dir, "site_zones"))


QUERIES = {"p6_found": p6_found}
