"""Spark-native text condensation and analytics."""
