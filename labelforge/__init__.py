"""Spark-native preparation and evaluation of structured-label text data."""
