"""Spark-native analytics for multi-annotator label panels and probabilistic predictions."""
