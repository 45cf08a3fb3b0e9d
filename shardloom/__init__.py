"""Spark-native analytics engine with the query surface of a sharded SQL database."""

__version__ = "0.1.0"
