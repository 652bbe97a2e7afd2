"""Quillmere: a PySpark-native engine for knowledge distilled from conversation streams."""
