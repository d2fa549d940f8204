"""pagemill: a PySpark-native engine for building and querying a document corpus."""

__version__ = "0.1.0"
