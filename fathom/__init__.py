"""Spark-native vector, full-text and hybrid retrieval over DataFrames."""
