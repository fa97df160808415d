"""Spark-native hybrid retrieval, document processing and corpus analytics."""
