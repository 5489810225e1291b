"""Spark-native analytics for scientific evidence tables."""
