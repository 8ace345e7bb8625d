"""Spark-native archive catalogue and search."""
