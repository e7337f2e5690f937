"""Spark-native engine for tick resampling, rolling factors and their evaluation."""
