"""Spark-native analytics over panels of aligned time series."""
