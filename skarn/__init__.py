"""Spark-native catalogue matching, retrieval evaluation and data-quality analytics."""
