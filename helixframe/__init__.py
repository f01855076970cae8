"""helixframe: a PySpark-native engine for sequence-alignment analytics."""

__version__ = "0.1.0"
