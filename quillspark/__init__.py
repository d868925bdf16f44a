"""Spark-native document search and text analytics."""
