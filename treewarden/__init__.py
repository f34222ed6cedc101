"""A Spark-native engine for deterministic analysis of source-code collections."""

__version__ = "0.1.0"
