"""Spark-native strike and bird-hazard analytics."""

__version__ = "0.1.0"
