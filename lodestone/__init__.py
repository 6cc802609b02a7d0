"""Spark-native data engine for retrieval-augmented question answering."""
