"""Spark-first analytics and retrieval engine for large document corpora."""
