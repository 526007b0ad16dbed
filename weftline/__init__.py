"""Spark-native knowledge-graph, retrieval and code analytics."""
