"""Spark-native analytics over conversation trees, embeddings, text and media metadata."""
