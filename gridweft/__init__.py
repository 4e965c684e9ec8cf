"""Spark-native structural-design analytics: connectivity, clock crossings, logic cones."""

__version__ = "0.1.0"
