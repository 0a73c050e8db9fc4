"""Tessella: a Spark-native engine for sentence-aligned parallel corpora."""
