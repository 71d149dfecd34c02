"""Spark-native analytics over document collections: text keys, linkage, similarity layers, graphs, curation, validation."""

__version__ = "0.1.0"
