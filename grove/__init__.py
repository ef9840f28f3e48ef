"""Spark-native acyclic join analytics."""
