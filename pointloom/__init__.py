"""Spark-native analytics over point-cloud frames."""
