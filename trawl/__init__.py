"""Retrieval, indexing and evaluation over Spark tables and streams."""
