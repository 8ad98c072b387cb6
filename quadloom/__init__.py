"""Spark-native linked-data analytics."""
