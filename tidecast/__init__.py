"""Spark-native probabilistic forecasting analytics."""
