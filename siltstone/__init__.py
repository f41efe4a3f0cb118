"""Spark-native analytics over repositories, change streams and documents."""
