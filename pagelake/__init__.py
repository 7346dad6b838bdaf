"""Spark-native processing of crawled documentation pages."""

__version__ = "0.1.0"
