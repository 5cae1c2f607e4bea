"""Gleanery: a Spark-native engine for building, querying and curating a web-text corpus."""

__version__ = "0.1.0"
