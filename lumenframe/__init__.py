"""Spark-native analytics over a time-ordered history of screen text."""

__version__ = "0.1.0"
