"""Spark-native archive analytics: files, chunks, blocks and catalogs as DataFrames."""

__version__ = "0.1.0"
