"""Spark-native analytics over municipal open data."""
