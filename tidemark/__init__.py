"""Tidemark: analytics over time-stamped social text, as PySpark DataFrame operators."""
