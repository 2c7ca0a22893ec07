"""Spark-native analytics over typed, evidence-carrying architecture graphs."""
