"""Spark-native analytics toolkit: DataFrame in, DataFrame out."""
