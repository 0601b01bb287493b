"""Spark-native retrieval analytics: every operator takes DataFrames and returns DataFrames."""
