"""Spark-native analytics over long-term memory tables."""
