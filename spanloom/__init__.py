"""Spark-native analytics over sensitive spans in free text."""

__version__ = "0.1.0"
