"""Spark-native multivariate analytics engine."""
