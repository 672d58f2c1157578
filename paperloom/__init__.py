"""Spark-native analytics over scientific-paper corpora: graph, retrieval, evaluation and table hygiene."""

__version__ = "0.1.0"
