"""Spark-native analytics for rasters, sensor models and ground displacement."""

__version__ = "0.1.0"
