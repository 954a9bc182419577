"""Spark-native knowledge-graph building, querying and analysis."""

__version__ = "0.1.0"
