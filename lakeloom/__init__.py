"""Spark-native dataset profiling, preparation, discovery and corpus preparation."""
