"""weftline: a PySpark-native analytics engine for findings, corpora and event data."""

__version__ = "0.1.0"
