"""Spark-native preparation and analysis of language-model training data."""

__version__ = "0.1.0"
