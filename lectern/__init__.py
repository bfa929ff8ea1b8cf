"""Spark-native analytics over recorded talks: cues, windows, slides, quotes, recall."""
