"""Spark-native document screening, ranking and evaluation."""

__version__ = "0.1.0"
