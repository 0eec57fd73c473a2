"""papyral: a PySpark-native engine for literature-trend analytics."""

__version__ = "0.1.0"
