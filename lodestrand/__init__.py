"""Spark-first engine for digest-addressed releases of record embeddings."""

__version__ = "0.1.0"
