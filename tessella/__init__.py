"""Tessella: a PySpark-native engine for evidence-backed category profiles of texts."""

__version__ = "0.1.0"
