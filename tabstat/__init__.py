"""Spark-native tabular statistics: numeric frames, regression, preprocessing, clustering and time series."""
