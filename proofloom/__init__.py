"""Spark-native evidence retrieval and trust analytics."""
