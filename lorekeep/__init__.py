"""Spark-native conversation-memory analytics."""

__version__ = "0.1.0"
