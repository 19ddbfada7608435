"""lexiforge: a Spark-native engine for keyword analytics and data preparation."""

__version__ = "0.1.0"
