"""Spark-native vector search and analytics: exact and graph nearest neighbours over DataFrames."""
