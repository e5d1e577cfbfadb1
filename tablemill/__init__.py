"""Spark-first table preparation and clustering."""

__version__ = "0.1.0"
