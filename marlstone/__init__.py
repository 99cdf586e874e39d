"""Spark-native engine for governed document analytics, retrieval, matching and validation."""
