"""Spark-native analytics for short sequencing reads."""
