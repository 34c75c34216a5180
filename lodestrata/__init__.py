"""Spark-native analytics over versioned code graphs and development history."""

__version__ = "0.1.0"
