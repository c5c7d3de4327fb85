"""A Spark-native engine for building knowledge graphs from documents and tables."""

__version__ = "0.1.0"
