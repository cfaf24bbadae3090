"""Spark-native text retrieval and corpus processing: every operator maps DataFrames to DataFrames."""
