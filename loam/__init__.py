"""Spark-native analytics over collections of source files and text documents."""
