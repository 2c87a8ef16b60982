"""Spark-native engine for finding, comparing and removing inserted material in long content streams."""
