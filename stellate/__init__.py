"""Stellate: a PySpark-native engine for vector analytics."""

__version__ = "0.1.0"
