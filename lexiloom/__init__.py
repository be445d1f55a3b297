"""lexiloom: a PySpark-native analytics engine for document corpora."""

__version__ = "0.1.0"
