"""lodestack: a PySpark-native engine for building and querying knowledge bases."""

__version__ = "0.1.0"
