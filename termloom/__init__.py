"""Spark-native text retrieval and corpus processing."""
