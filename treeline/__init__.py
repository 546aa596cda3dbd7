"""Spark-native analytics over source-code and document corpora."""

__version__ = "0.1.0"
