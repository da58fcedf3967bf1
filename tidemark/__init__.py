"""Tidemark: market-event analytics as declarative PySpark operators."""
