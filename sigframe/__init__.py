"""Spark-native stimulus/response time-series analytics."""

__version__ = "0.1.0"
