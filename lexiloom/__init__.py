"""Spark-native analytics for localisation catalogs, hand-off files and source text."""
