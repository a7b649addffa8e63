"""Spark-native analytics for labelled text corpora."""
