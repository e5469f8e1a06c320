"""Spark-native toolkit for tabular binary-classification analytics."""
