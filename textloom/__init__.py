"""Spark-native analytics over large collections of labelled texts."""
