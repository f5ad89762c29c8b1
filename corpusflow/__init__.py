"""Spark-native preparation, retrieval and evaluation of document corpora."""
