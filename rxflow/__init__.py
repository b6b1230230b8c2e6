"""Spark-native curation and evaluation of reaction-style records."""
