"""Spark-native layout analytics engine."""
