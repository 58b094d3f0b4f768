"""reelrank: a Spark-native engine for explainable title search, relevance
evaluation and large-scale record processing."""

__version__ = "0.1.0"
