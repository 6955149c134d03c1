"""Spark-native analytics over large line-oriented logs and JSON Lines."""
