"""Spark-native categorisation of financial transactions."""
