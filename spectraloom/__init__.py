"""Spark-native analytics over peak lists, sequences, embeddings and documents."""
