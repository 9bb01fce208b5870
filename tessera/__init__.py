"""Spark-native catalog, signal and design-matrix engine."""

__version__ = "0.1.0"
