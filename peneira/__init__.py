"""Peneira: a PySpark-native engine for collected job-listing records."""

__version__ = "0.1.0"
