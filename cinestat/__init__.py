"""Spark-native analytics for grouped, array-valued time series and images."""
